"""A hierarchical Pitman-Yor language model over words, with the word before as context.

Each word has a restaurant, whose customers are the words that follow it and whose dishes come from one restaurant above, which all contexts
share; that one's dishes come from a uniform base over the V training words and one unknown word. A table of a context is a customer above. The
start of a text has the context of the end token.

Seatings are sampled by Gibbs. Two auxiliary draws make all parties (the n customers of one context that eat one dish) independent of each other:
each context's z ~ Gamma(strength / discount + its tables), which takes the place of the rising factorial of its tables, and the probabilities
of the restaurant above, drawn from their posterior given its seating. Given these, the seating of a party is drawn at once: t tables with the
probability S(n, t) * (discount * z * probability above)**t, where the generalised Stirling number S counts the seatings of n customers at
t tables. Up to ``EXACT`` customers S is exact; beyond, t makes Metropolis steps with the saddle-point value of S, mended by
what it misses at ``REFERENCE`` customers. So a party costs the same however
many customers it has, and a hot context or word is dealt to as many tasks as it has parties. Parties of one have one table and need no draw.
Strengths are drawn by Gibbs on a grid during ``BURN_IN`` sweeps and then stay; discounts come from the counts of counts. Predictive
probabilities are averaged over ``SAMPLES`` sweeps after that. Tables, customers and totals of a sample are of one sweep, so that the probabilities
after a context sum to 1 over the V words and the unknown one.

Documents are read once into chunks of about ``CHUNK`` bytes, in which tokens are numbers into a list of the chunk's words; longer texts are cut
between words, with the word before as the next piece's context. Chunks, blocks of words and buckets of word pairs are rows of staged tables that
send each other packed lists, in which each word or pair stands once for each chunk: chunks ask blocks for their words' ids and counts, and buckets
for their pairs' counts; in a sweep, buckets draw seatings and tell blocks the sums, blocks tell buckets z and the probabilities above. Blocks and
buckets grow in number with the words and pairs. Nothing of the vocabulary's size is broadcast or goes to the driver. Words are told apart by 64-bit
hashes, and numbered in 32 bits: a corpus of over 2**32 - 1 distinct words is refused with an error.

Nulls count as empty texts, of one end token. Rows without a doc_id are held out. Repeated rows count as often as they stand. With no training
document, N and V are 0, base scores have no finite value where N + 0.1 is all there is but are defined (1 for each token), and words have the
uniform base. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, staged, table
from .mail import BINARY, MAIL, cuts, letters, packed, packed_sorted, post, posted, sent, unpacked, unpacked_sorted
from .words import mixed

CHUNK = 8 << 20
#: Words that chunks ask for in one block, and tokens for each bucket of pairs, on average.
ASKED = 1 << 18
PAIR_TOKENS = 3 << 19
BURN_IN = 3
SAMPLES = 3
#: Customers of a party up to which numbers of seatings are exact, and Metropolis steps of larger ones in a sweep.
EXACT = 128
STEPS = 12
#: Customers for whom the miss of the saddle point is taken.
REFERENCE = 2048
#: Strengths to choose from.
GRID = np.geomspace(0.25, 1024, 25)
_GAP = re.compile(rb"[ \t-\r]")
_LOW = np.uint64(0xFFFFFFFF)
_UP = np.uint64(32)


#: Kinds of mail: ids and counts for a chunk's words; a block's counts, singles, tables, customers and tables above; parties of a bucket; their tables; classes of a chunk's
#: pairs; sums over parties of one, and of more; what a block tells a bucket; what is known of a chunk's words, and of its pairs.
IDS, BLOCK, PARTIES, TABLES, CLASSES, SINGLES, REPLY, TOLD, WORDS, PAIRS = range(10)


# --- seatings ---------------------------------------------------------------------------------------------------------------------------


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive numbers, by Stirling's series after seven steps up."""
    x = np.asarray(x, np.float64)
    steps = np.log(x * (x + 1) * (x + 2)) + np.log((x + 3) * (x + 4) * (x + 5) * (x + 6))
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - steps


def _next_row(row: np.ndarray, n: int, discount: float) -> np.ndarray:
    """log S(n + 1, t) for t from 0, from log S(n, t)."""
    with np.errstate(divide="ignore"):
        joined = row + np.log(np.maximum(n - np.arange(len(row)) * discount, 0))
    return np.logaddexp(np.concatenate([[-np.inf], row[:-1]]), joined)


@functools.lru_cache(maxsize=4)
def seating_logs(discount: float, most: int = EXACT) -> np.ndarray:
    """log S(n, t) for n up to ``most``: the sum, over all ways to seat n customers at t tables, of what the discount leaves of their weights."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for n in range(1, most):
        out[n + 1] = _next_row(out[n], n, discount)
    return out


def _saddle(n: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(n, t) - log n! by a saddle point of the generating function ((1 - (1 - x)**discount) / discount)**t / t!, for 1 <= t < n."""
    low, high = np.full(len(n), -700.0), np.full(len(n), -1e-12)  # log(1 - x)
    ratio = n / t
    for _ in range(48):
        y = (low + high) / 2
        over = discount * np.expm1(y) * np.exp(y * (discount - 1)) / np.expm1(y * discount) > ratio
        low, high = np.where(over, y, low), np.where(over, high, y)
    y = (low + high) / 2
    x = -np.expm1(y)
    spread = n * (1 + (1 - discount) * x / np.exp(y) - ratio)
    f = -np.expm1(y * discount) / discount
    return -_lgamma(t + 1.0) + t * np.log(f) - n * np.log(x) - 0.5 * np.log(2 * np.pi * np.maximum(spread, 1e-12))


@functools.lru_cache(maxsize=4)
def _misses(discount: float) -> tuple[np.ndarray, np.ndarray]:
    """What the saddle point misses, which depends on t / n**discount alone where n is large, by the logarithm of that: from exact rows for REFERENCE customers."""
    row = np.full(REFERENCE + 1, -np.inf)
    row[1] = 0.0
    for n in range(1, REFERENCE):
        row = _next_row(row, n, discount)
    t = np.unique(np.geomspace(1, REFERENCE // 2, 200).astype(np.int64))
    n = np.full(len(t), float(REFERENCE))
    return np.log(t) - discount * np.log(REFERENCE), row[t] - _lgamma(np.array([REFERENCE + 1.0])) - _saddle(n, t.astype(np.float64), discount)


def seating_log_large(n: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log S(n, t) - log n! for n over EXACT and 1 <= t < n: the saddle point and what it misses."""
    at, miss = _misses(discount)
    r = np.log(t) - discount * np.log(n)
    slope = (miss[1] - miss[0]) / (at[1] - at[0])
    return _saddle(n, t, discount) + np.where(r < at[0], miss[0] + slope * (r - at[0]), np.interp(r, at, miss))


def seated(n: np.ndarray, log_x: np.ndarray, before: np.ndarray | None, discount: float, random: np.random.Generator) -> np.ndarray:
    """Tables of parties of ``n``, drawn with probabilities S(n, t) * x**t; ``before`` has the tables they had."""
    out = (n > 0).astype(np.int64)
    logs = seating_logs(discount)
    order = np.argsort(n, kind="stable")
    order = order[np.searchsorted(n[order], 2) :]
    for at in np.split(order, np.nonzero(np.diff(n[order]))[0] + 1):
        if not len(at) or (k := int(n[at[0]])) > EXACT:
            break
        p = logs[k, 1 : k + 1] + log_x[at, None] * np.arange(1, k + 1)
        p = np.cumsum(np.exp(p - p.max(axis=1, keepdims=True)), axis=1)
        out[at] = 1 + (p < random.random(len(at))[:, None] * p[:, -1:]).sum(axis=1)
    at = np.nonzero(n > EXACT)[0]
    if len(at):
        many, x = n[at].astype(np.float64), log_x[at]

        def weight(t):
            return seating_log_large(many, t, discount) + t * x

        if before is None:  # the best of a few to start from
            tries = [np.clip(np.floor(many ** (k / 16)), 1, many - 1) for k in range(16)]
            t = np.stack(tries)[np.argmax([weight(x) for x in tries], axis=0), np.arange(len(at))]
        else:
            t = np.clip(before[at].astype(np.float64), 1, many - 1)
        now = weight(t)
        for step in range(STEPS):
            reach = np.maximum(1, np.floor(many**discount / 4 ** (step % 4 + 1)))
            to = t + np.floor(random.random(len(at)) * (2 * reach + 1)) - reach
            inside = (to >= 1) & (to < many)
            new = weight(np.where(inside, to, t))
            taken = inside & (np.log(random.random(len(at))) < new - now)
            t, now = np.where(taken, to, t), np.where(taken, new, now)
        out[at] = t
    return out


def strength_logs(tables: np.ndarray, customers: np.ndarray, discount: float) -> np.ndarray:
    """The log likelihood of each strength of GRID, given tables and customers of restaurants."""
    pairs, n = np.unique(tables.astype(np.uint64) << _UP | np.minimum(customers, int(_LOW)).astype(np.uint64), return_counts=True)
    t, c = (pairs >> _UP).astype(np.float64), (pairs & _LOW).astype(np.float64)
    return np.array([(n * (_lgamma(s / discount + t) - _lgamma(s / discount) - _lgamma(s + c) + _lgamma(s))).sum() for s in GRID])


def discount_of(once: float, twice: float) -> float:
    """The discount that counts of counts tell."""
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once + twice > 0 else 0.5


# --- chunks -----------------------------------------------------------------------------------------------------------------------------

_CHUNK = {"chunk": pa.int64(), "rows": pa.list_(pa.int64()), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "before": pa.list_(pa.int32()), "tokens": pa.binary(), "hashes": pa.binary()}
CHUNKS = "chunk long, rows array<long>, doc_ids array<long>, lengths array<long>, before array<int>, tokens binary, hashes binary"


def pieces(raw: bytes, most: int):
    """A text cut between words into pieces of about ``most`` bytes."""
    at = 0
    while len(raw) - at > most and (gap := _GAP.search(raw, at + most)):
        yield raw[at : gap.start()]
        at = gap.end()
    yield raw[at:]


def _chunks(docs: DataFrame, size: int) -> DataFrame:
    """One row for each chunk: its texts' rows, ids and lengths, the word before each, all tokens as numbers, and its words' hashes."""

    def run(batches):
        part, row, nth = TaskContext.get().partitionId(), 0, 0
        number: dict[bytes, int] = {b"": 0}
        rows, ids, lengths, before, tokens, held = [], [], [], [], [], 0

        def closed():
            words = list(number)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
            flat = np.concatenate(tokens)
            order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")  # numbers by frequency
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            values = [part << 32 | nth, rows, ids, lengths, rank[before].tolist(), packed(rank[flat]), hashes[order].tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _CHUNK.values())], names=list(_CHUNK))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                last, todo = 0, [*pieces((text.as_py() or "").encode("utf-8", "surrogatepass").lower(), size)]
                for i, raw in enumerate(todo):
                    words = raw.split()
                    if i == len(todo) - 1:
                        words.append(b"")
                    if words:
                        rows.append(part << 40 | row)
                        ids.append(doc)
                        lengths.append(len(words))
                        before.append(last)
                        tokens.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
                        last, held = int(tokens[-1][-1]), held + len(raw) + 1
                    if held >= size:
                        yield closed()
                        word = next(w for w, k in number.items() if k == last) if i < len(todo) - 1 else b""
                        nth, number = nth + 1, {b"": 0}
                        last = number.setdefault(word, len(number))
                        rows, ids, lengths, before, tokens, held = [], [], [], [], [], 0
                row += 1
        if rows:
            yield closed()

    return docs.mapInArrow(run, CHUNKS)


def held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0


class _Chunk:
    """Tokens of a chunk, the word before each, the text that each is in, and whether it is held out."""

    def __init__(self, row: dict):
        self.row = row
        self.tokens = unpacked(row["tokens"])
        lengths = np.array(row["lengths"])
        self.before = np.concatenate([self.tokens[:1], self.tokens[:-1]])
        self.before[np.cumsum(lengths) - lengths] = row["before"]
        self.text = np.repeat(np.arange(len(lengths)), lengths)
        self.held = np.array([held_out(d) for d in row["doc_ids"]])
        self.hashes = np.frombuffer(row["hashes"], np.uint64)

    def dealt(self, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """The chunk's words in the order of (block, hash), and their blocks."""
        block = self.hashes % np.uint64(blocks)
        order = np.lexsort((self.hashes, block))
        return order, block[order].astype(np.int64)

    def known(self, mail: pa.Table, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and counts of the chunk's words, and the order in which blocks tell them."""
        order, block = self.dealt(blocks)
        got = letters(mail, IDS)
        ids, counts = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        ids[order] = np.concatenate([unpacked(x["a"]) for x in got]) * blocks + block
        counts[order] = np.concatenate([unpacked(x["b"]) for x in got])
        if ids.max() >= 1 << 32:
            raise ValueError("over 2**32 - 1 distinct words")
        return ids, counts, order

    def pairs(self, ids: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct pairs of training words in the order of (bucket, pair), their buckets, which tokens have one, and its place there."""
        seen = np.nonzero((counts[self.before] > 0) & (counts[self.tokens] > 0))[0]
        distinct, at = np.unique(ids[self.before[seen]].astype(np.uint64) << _UP | ids[self.tokens[seen]].astype(np.uint64), return_inverse=True)
        bucket = (mixed(distinct) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return distinct[order], bucket[order], seen, place[at]


def _asking(blocks: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = _Chunk(row)
                n = np.bincount(own.tokens[~own.held[own.text]], minlength=len(own.hashes))
                order, block = own.dealt(blocks)
                present, starts = cuts(block)
                yield from posted({"to": int(b), "sender": row["chunk"], "kind": IDS, "a": own.hashes[i].tobytes(), "b": packed(n[i])} for b, i in zip(present, np.split(order, starts)))

    return run


def _numbering(group: pa.Table) -> pa.Table:
    """A block's words numbered by frequency, told to the chunks that ask for them."""
    asked = group.to_pylist()
    hashes = [np.frombuffer(x["a"], np.uint64) for x in asked]
    distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
    n = np.bincount(at, np.concatenate([unpacked(x["b"]) for x in asked]), len(distinct)).astype(np.int64)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    cuts = np.cumsum([len(x) for x in hashes])[:-1]
    block = asked[0]["to"]
    out = [{"to": x["sender"], "sender": block, "kind": IDS, "a": packed(rank[i]), "b": packed(n[i])} for x, i in zip(asked, np.split(at, cuts))]
    return post([*out, {"to": block, "sender": block, "kind": BLOCK, "sums": [float(n.sum()), float((n > 0).sum())], "a": packed(n[order])}])


def _pairing(blocks: int, buckets: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            own = _Chunk(row)
            ids, counts, _ = own.known(right, blocks)
            keys, bucket, seen, at = own.pairs(ids, counts, buckets)
            n = np.bincount(at, ~own.held[own.text[seen]], len(keys))
            present, starts = cuts(bucket)
            for b, k, m in zip(present, np.split(keys, starts), np.split(n, starts)):
                out.append({"to": int(b), "sender": row["chunk"], "kind": PAIRS, "a": packed_sorted(k.view(np.int64)), "b": packed(m)})
        return post(out)

    return run


# --- sweeps -----------------------------------------------------------------------------------------------------------------------------


def _by_block(ids: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids as block << 32 | number within it, ascending, and each id's place there."""
    ids = ids.astype(np.uint64)
    return np.unique(ids % np.uint64(blocks) << _UP | ids // np.uint64(blocks), return_inverse=True)


def _sums(sender: int, kind: int, keys: np.ndarray, n: np.ndarray, blocks: int) -> list[dict]:
    """Letters to blocks: for their words as contexts and as dishes, numbers and sums of ``n`` over pairs."""
    sides = []
    for ids in (keys >> _UP, keys & _LOW):
        distinct, at = _by_block(ids, blocks)
        total = np.bincount(at, n, len(distinct)).astype(np.int64)
        present, starts = cuts((distinct >> _UP).astype(np.int64))
        sides.append({int(b): (packed_sorted(k & _LOW), packed(s)) for b, k, s in zip(present, np.split(distinct, starts), np.split(total, starts))})
    none = packed(np.zeros(0, np.int64))
    out = []
    for block in sorted({*sides[0], *sides[1]}):
        (a, b), (c, d) = (x.get(block, (none, none)) for x in sides)
        out.append({"to": block, "sender": sender, "kind": kind, "a": a, "b": b, "c": c, "d": d})
    return out


def _merging(blocks: int):
    """Counts of a bucket's pairs over all chunks: parties of two or more stay, sums go to the blocks, and chunks get classes of their pairs."""

    def run(group: pa.Table) -> pa.Table:
        asked = group.to_pylist()
        keys = [unpacked_sorted(x["a"]).view(np.uint64) for x in asked]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate([unpacked(x["b"]) for x in asked]), len(distinct)).astype(np.int64)
        kind, party = np.minimum(n, 2), np.cumsum(n > 1) - 1
        bucket, out = asked[0]["to"], []
        for x, i in zip(asked, np.split(at, np.cumsum([len(k) for k in keys])[:-1])):
            out.append({"to": bucket, "sender": x["sender"], "kind": CLASSES, "a": packed(kind[i]), "b": packed_sorted(party[i[n[i] > 1]])})
        many = n > 1
        out.append({"to": bucket, "sender": bucket, "kind": PARTIES, "sums": [float((n == 1).sum()), float((n == 2).sum())], "a": packed_sorted(distinct[many].view(np.int64)), "b": packed(n[many])})
        out += _sums(bucket, SINGLES, distinct[n == 1], n[n == 1], blocks) + _sums(bucket, REPLY, distinct[many], np.ones(int(many.sum())), blocks)
        return post(out)

    return run


class Scalars:
    """What all restaurants share: discounts and strengths of contexts and of the restaurant above, its customers and tables, and the base."""

    def __init__(self, discount: float, above: float, base: float):
        self.discount, self.above, self.base = discount, above, base
        self.strength, self.strength_above, self.tables, self.customers = 1.0, 1.0, 0.0, 0.0

    def top(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The predictive probability of words above."""
        return (customers - self.above * tables + (self.strength_above + self.above * self.tables) * self.base) / (self.strength_above + self.customers)

    def back(self, tables: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The probability that a context takes its word from above."""
        return (self.strength + self.discount * tables) / (self.strength + count)


def _updating(sweep: int, s: Scalars, log_x: float):
    """A block's tables and customers from the buckets' sums; draws its words' tables above, z and unscaled probabilities, and tells them."""

    def run(state: pa.Table, mail: pa.Table) -> pa.Table:
        own = letters(state, BLOCK)[0]
        block, count = own["to"], unpacked(own["a"])
        single = [unpacked(own[c]) if own[c] else np.zeros(len(count), np.int64) for c in "bc"]
        got = [{c: (unpacked_sorted if c in "ac" else unpacked)(x[c]) for c in "abcd"} | {"sender": x["sender"], "kind": x["kind"]} for k in (SINGLES, REPLY) for x in letters(mail, k)]
        for x in got:
            if x["kind"] == SINGLES:
                single[0][x["a"]] += x["b"]
                single[1][x["c"]] += x["d"]
        tables, customers = single[0].copy(), single[1].copy()
        for x in got:
            if x["kind"] == REPLY:
                tables[x["a"]] += x["b"]
                customers[x["c"]] += x["d"]
        random = np.random.default_rng([sweep, block, 1])
        top = seated(customers, np.full(len(count), log_x), unpacked(own["f"]) if own["f"] else None, s.above, random)
        z = random.gamma(s.strength / s.discount + tables)
        g = random.gamma(np.maximum(customers - s.above * top, 0))
        some = count > 0
        sums = [top.sum(), customers.sum(), g.sum(), (customers == 1).sum(), (customers == 2).sum(), *strength_logs(tables[some], count[some], s.discount)]
        out = [{"to": block, "sender": block, "kind": BLOCK, "sums": [float(x) for x in sums]} | {c: packed(v) for c, v in zip(BINARY, (count, *single, tables, customers, top))}]
        out += [{"to": x["sender"], "sender": block, "kind": TOLD, "a": z[x["a"]].astype("<f4").tobytes(), "b": g[x["c"]].astype("<f4").tobytes()} for x in got if x["kind"] == REPLY]
        return post(out)

    return run


def _drawing(sweep: int, s: Scalars, total: float, rest: float, blocks: int):
    """The tables of a bucket's parties, given what blocks have told, and their sums for the blocks."""

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        parties, before, got = letters(own, PARTIES)[0], letters(own, TABLES), letters(told, TOLD)
        keys, n = unpacked_sorted(parties["a"]).view(np.uint64), unpacked(parties["b"])
        z, g = (np.concatenate([np.frombuffer(x[c], "<f4") for x in got] or [np.zeros(0)]).astype(np.float64) for c in "ab")
        u, w = _by_block(keys >> _UP, blocks)[1], _by_block(keys & _LOW, blocks)[1]
        log_x = np.log(s.discount * z[u]) + np.log((g[w] + rest * s.base) / total)
        tables = seated(n, log_x, unpacked(before[0]["a"]) if before else None, s.discount, np.random.default_rng([sweep, parties["to"], 2]))
        return post([{"to": parties["to"], "sender": sweep, "kind": TABLES, "a": packed(tables)}, *_sums(parties["to"], REPLY, keys, tables, blocks)])

    return run


def _chosen(logs: np.ndarray, random: np.random.Generator) -> float:
    p = np.exp(logs - logs.max())
    return float(random.choice(GRID, p=p / p.sum()))


class Model:
    """The samples: parties' tables and blocks of words, as tables, and the scalars of each."""

    def __init__(self, vocabulary: DataFrame, census: DataFrame, blocks: int, n_words: int, burn_in: int = BURN_IN, samples: int = SAMPLES):
        parties = sent(census, PARTIES)
        # one row for each block or bucket is summed
        once, twice = (float(x or 0) for x in parties.agg(F.sum(F.col("sums")[0]), F.sum(F.col("sums")[1])).first())
        s = Scalars(discount_of(once, twice), 0.5, 1 / (n_words + 1))
        random = np.random.default_rng(7)
        state, mail, own = sent(vocabulary, BLOCK), census.where(F.col("kind").isin(SINGLES, REPLY)), parties
        self.samples: list[tuple[DataFrame, DataFrame, Scalars]] = []
        drawn = None
        for sweep in range(burn_in + samples + 1):
            log_x = float(np.log(s.above * random.gamma(s.strength_above / s.above + s.tables + (sweep == 0)) * s.base))
            state = staged(state.groupBy("to").cogroup(mail.groupBy("to")).applyInArrow(_updating(sweep, s, log_x), MAIL), "blocks")
            release(state.sparkSession)
            got = sent(state, BLOCK).agg(*[F.sum(F.col("sums")[i]) for i in range(5 + len(GRID))]).first()
            tables, customers, g, once, twice, *logs = (float(x or 0) for x in got)
            s = _copied(s, tables, customers)
            if sweep > burn_in:
                self.samples.append((sent(drawn, TABLES), sent(state, BLOCK), s))
            else:  # the strengths of the last sweep to burn in stay
                s.strength = _chosen(np.array(logs), random)
                s.strength_above = _chosen(strength_logs(np.array([tables]), np.array([customers]), s.above), random)
                if sweep == 0:
                    s.above = discount_of(once, twice)
            if sweep == burn_in + samples:
                break
            rest = float(random.gamma(s.strength_above + s.above * tables))
            drawn = staged(own.groupBy("to").cogroup(sent(state, TOLD).groupBy("to")).applyInArrow(_drawing(sweep, s, g + rest, rest, blocks), MAIL), "tables")
            release(state.sparkSession)
            own, mail, state = parties.unionByName(sent(drawn, TABLES)), sent(drawn, REPLY), sent(state, BLOCK)

    @property
    def scalars(self) -> list[Scalars]:
        return [s for _, _, s in self.samples]


def _copied(s: Scalars, tables: float, customers: float) -> Scalars:
    out = Scalars(s.discount, s.above, s.base)
    out.strength, out.strength_above, out.tables, out.customers = s.strength, s.strength_above, tables, customers
    return out


# --- scores -----------------------------------------------------------------------------------------------------------------------------


def _telling_words(asked: pa.Table, states: pa.Table) -> pa.Table:
    """For each chunk's words of a block: tables as a context, customers and tables above, sample by sample."""
    samples = [{c: unpacked(x[c]) for c in "def"} for x in sorted(states.to_pylist(), key=lambda x: x["sender"])]
    out = []
    for x in asked.to_pylist():
        rank = unpacked(x["a"])
        out.append({"to": x["to"], "sender": x["sender"], "kind": WORDS} | {c: packed(np.stack([y[c][rank] for y in samples]).ravel()) for c in "def"})
    return post(out)


def _telling_pairs(asked: pa.Table, own: pa.Table) -> pa.Table:
    """For each chunk's pairs of a bucket: how often they stand, and the sum of their tables over the samples."""
    n = unpacked(letters(own, PARTIES)[0]["b"])
    samples = [unpacked(x["a"]) for x in letters(own, TABLES)]
    tables = np.sum(samples, axis=0)
    out = []
    for x in asked.to_pylist():
        kind, party = unpacked(x["a"]), unpacked_sorted(x["b"])
        count, sums = kind.copy(), kind * len(samples)
        count[kind == 2], sums[kind == 2] = n[party], tables[party]
        out.append({"to": x["sender"], "sender": x["to"], "kind": PAIRS, "a": packed(count), "b": packed(sums)})
    return post(out)


PIECES = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double"
_PIECES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _scoring(scalars: list[Scalars], total: int, n_words: int, blocks: int, buckets: int):
    def run(left: pa.Table, mail: pa.Table) -> pa.Table:
        out = [_PIECES.empty_table()]
        for row in left.to_pylist():
            own = _Chunk(row)
            ids, count, order = own.known(mail, blocks)
            samples, size = len(scalars), len(count)
            told = {c: np.empty((samples, size), np.int64) for c in "def"}
            for c in "def":
                told[c][:, order] = np.concatenate([unpacked(x[c]).reshape(samples, -1) for x in letters(mail, WORDS)], axis=1)
            keys, _, seen, at = own.pairs(ids, count, buckets)
            got = letters(mail, PAIRS)
            n, tables = (np.concatenate([unpacked(x[c]) for x in got] or [np.zeros(0, np.int64)]) for c in "ab")
            p = sum(s.back(t, count)[own.before] * s.top(c, a)[own.tokens] for s, t, c, a in zip(scalars, told["d"], told["e"], told["f"])) / samples
            p[seen] += (n - scalars[0].discount * tables / samples)[at] / (scalars[0].strength + count[own.before[seen]])
            base = np.log10((count + 0.1) / (total + 0.1 * (n_words + 1)))
            texts = len(row["rows"])
            sums = [np.bincount(own.text, x, texts) for x in (count[own.tokens] > 0, base[own.tokens], np.log10(p))]
            out.append(pa.table([row["rows"], row["doc_ids"], row["lengths"], sums[0].astype(np.int64), sums[1], sums[2]], schema=_PIECES))
        return pa.concat_tables(out)

    return run


def counted(docs: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame, DataFrame, int, int, int, int]:
    """The chunks, the vocabulary and the census of pairs; N and V; how many blocks and buckets there are."""
    spark = docs.sparkSession
    chunks = staged(_chunks(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), chunk), "chunks")
    asked, tokens = chunks.agg(F.sum(F.octet_length("hashes")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    blocks, buckets = max(1, -(-(asked or 0) // (8 * ASKED))), max(1, -(-(tokens or 0) // PAIR_TOKENS))
    vocabulary = staged(chunks.mapInArrow(_asking(blocks), MAIL).groupBy("to").applyInArrow(_numbering, MAIL), "vocabulary")
    total, n_words = (int(x or 0) for x in sent(vocabulary, BLOCK).agg(F.sum(F.col("sums")[0]), F.sum(F.col("sums")[1])).first())
    release(spark)
    pairs = chunks.groupBy("chunk").cogroup(sent(vocabulary, IDS).groupBy("to")).applyInArrow(_pairing(blocks, buckets), MAIL)
    census = staged(pairs.groupBy("to").applyInArrow(_merging(blocks), MAIL), "census")
    release(spark)
    return chunks, vocabulary, census, total, n_words, blocks, buckets


def score(docs: DataFrame, chunk: int = CHUNK, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """Both scores of every document; those whose crc32(doc_id) % 10 is not 0 train the model."""
    chunks, vocabulary, census, total, n_words, blocks, buckets = counted(docs, chunk)
    model = Model(vocabulary, census, blocks, n_words, burn_in, samples)
    states = [s.withColumn("sender", F.lit(i).cast("long")) for i, (_, s, _) in enumerate(model.samples)]
    words = sent(vocabulary, IDS).groupBy("sender").cogroup(functools.reduce(DataFrame.unionByName, states).groupBy("to")).applyInArrow(_telling_words, MAIL)
    parties = functools.reduce(DataFrame.unionByName, [t for t, _, _ in model.samples], sent(census, PARTIES))
    pairs = sent(census, CLASSES).groupBy("to").cogroup(parties.groupBy("to")).applyInArrow(_telling_pairs, MAIL)
    mail = sent(vocabulary, IDS).unionByName(words).unionByName(pairs)
    found = chunks.groupBy("chunk").cogroup(mail.groupBy("to")).applyInArrow(_scoring(model.scalars, total, n_words, blocks, buckets), PIECES)
    whole = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    held = F.col("doc_id").isNull() | (F.crc32(F.col("doc_id").cast("string")) % 10 == 0)
    return whole.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
