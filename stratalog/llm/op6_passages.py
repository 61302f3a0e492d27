"""Passages that repeat across documents, exactly or nearly, by chains of shared seeds.

Seeds are the minimizers of runs of ``K`` words: any stretch of K + WINDOW - 1 equal words has one in common. Chunks of texts send their seeds'
hashes, each once and packed, to buckets of hashes, and get back which of them other documents have too; only those become rows. Each place of a
seed is linked to the least doc_id that has the seed and to the last one before its own, so that a passage in n documents makes 2 n links, not n * n.
The links of a document to one earlier document are chained: links on one diagonal at less than ``APART`` words are one segment; segments follow
each other at increasing places in both, with a gain for each seed and a cost for each word skipped on either side, the best chain before each
segment looked up in a Fenwick tree of prefix maxima. Chains of two seeds or more are aligned word by word: between segments with one jump at the
best place, then outwards while the score stays within ``DROP`` of its best. Only the words of a chain and ``MARGIN`` words around it are brought
together for this; where that does not settle an end, the whole texts are. Passages of ``LEAST`` words or more, of which at least ``IDENTITY`` agree,
are returned, each with the earlier document that has it.

A passage whose parts stand in several other documents may have links to none that has it whole. Where a document's seeds that earlier ones have
could hold LEAST equal words outside its passages so far, all documents with these seeds give the hashes of their runs of LEAST words there, and
each run is linked to the first document that has it whole. So exact repeats of LEAST words are found wherever else their parts stand.

Words are what spaces, tabs and line ends part, lower-cased, and are told apart by 64-bit hashes, within
an alignment by 40 bits of them. Nulls and texts of fewer than K words have no seeds. Rows without a
doc_id are neither searched nor sources. Rows that repeat a doc_id count as one document, that whose text has the least hash. Texts of any length go
whole. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, release, staged, table
from .mail import MAIL, cuts, letters, packed, packed_sorted, post, posted, unpacked, unpacked_sorted
from .words import grams, hashed, mixed

#: With random substitutions, 97 % of passages of 50 words at IDENTITY keep two seeds.
K = 4
WINDOW = 6
#: What a seed adds to a chain, and a word that is skipped takes; so two seeds at less than APART words make one, as two in a passage of LEAST words.
GAIN = 6
SKIP = 0.05
APART = 60
LEAST = 50
IDENTITY = 0.8
DROP = 12
MARGIN = 32
#: Words of a chunk of texts, and seeds of a bucket, on average.
CHUNK_WORDS = 1 << 20
BUCKET = 1 << 20
#: Places of a seed in a part, and chains of a document in one row.
PART = 20_000
NEEDS = 512
ASKED, SHARED = 0, 1
PASSAGES = "doc_id long, start long, length long, source_doc_id long, source_start long, source_length long, identity double"
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def seeds(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, texts and places of the seeds of texts, given as their words' hashes. Of a run of equal seeds, as repeated words make, one in each WINDOW
    words is kept and its hash tells which it is."""
    texts_ = [(i, w) for i, w in enumerate(texts) if len(w) >= K]
    if not texts_:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # texts side by side, with WINDOW runs between that no window takes
    sizes = np.array([len(w) - K + 1 for _, w in texts_])
    starts = np.cumsum(sizes + WINDOW) - sizes
    all_ = np.full(starts[-1] + sizes[-1] + WINDOW, _MOST)
    place = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    flat = grams(np.concatenate([w for _, w in texts_]), K)
    first = np.cumsum([len(w) for _, w in texts_]) - [len(w) for _, w in texts_]
    all_[place] = flat[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
    least = all_[: len(all_) - WINDOW + 1].copy()
    for i in range(1, WINDOW):
        np.minimum(least, all_[i : len(all_) - WINDOW + 1 + i], out=least)
    # a run is a seed if it is the least of a window that it stands in: of the greatest of the least
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
    most = padded[: len(all_)].copy()
    for i in range(1, WINDOW):
        np.maximum(most, padded[i : len(all_) + i], out=most)
    chosen = np.nonzero((all_[place] == most[place]))[0]
    of = np.repeat(np.arange(len(sizes)), sizes)[chosen]
    at, h = place[chosen] - starts[of], all_[place[chosen]]
    run = np.cumsum(np.concatenate([[True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])])) - 1
    since = (at - at[np.searchsorted(run, run)]) // WINDOW
    new = np.concatenate([[True], (run[1:] != run[:-1]) | (since[1:] != since[:-1])])
    h, since = h[new], since[new].astype(np.uint64)
    return np.where(since == 0, h, mixed(h + since)), np.array([i for i, _ in texts_])[of[new]], at[new]


def segments(pair: np.ndarray, p: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Runs of links on one diagonal, as rows (pair, first p, first a, last p, last a, links), by pair."""
    if not len(p):
        return np.zeros((0, 6), np.int64)
    order = np.lexsort((p, a - p, pair))
    pair, p, a = pair[order], p[order], a[order]
    fresh = np.concatenate([[True], (pair[1:] != pair[:-1]) | (np.diff(a - p) != 0) | (np.diff(p) >= APART)])
    new = np.concatenate([[True], fresh[1:] | (np.diff(p) != 0)])  # a link that is there twice counts once
    start = np.nonzero(fresh)[0]
    end = np.concatenate([start[1:], [len(p)]]) - 1
    return np.stack([pair[start], p[start], a[start], p[end], a[end], np.add.reduceat(new.astype(np.int64), start)], axis=1)


def chains(parts: list[tuple[int, int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Chains of segments (first p, first a, last p, last a, links), as the ends of their segments; a segment is in one chain at most."""
    if len(parts) == 1:
        p, a, q, b, n = parts[0]
        return [[(p, a), (q, b)]] if n > 1 else []
    parts = sorted(parts)
    ranks = {a: i + 1 for i, a in enumerate(sorted({x[3] for x in parts}))}
    ends = sorted(ranks)
    tree: list[tuple[float, int]] = [(0.0, -1)] * (len(ranks) + 1)
    waiting = sorted(range(len(parts)), key=lambda i: parts[i][2])
    gain, before, nth = [0.0] * len(parts), [-1] * len(parts), 0
    for i, (p, a, q, b, n) in enumerate(parts):
        while parts[waiting[nth]][2] < p:  # segments that end before this one
            j = waiting[nth]
            value, r = (gain[j] + SKIP * (parts[j][2] + parts[j][3]), j), ranks[parts[j][3]]
            while r < len(tree):
                if value[0] > tree[r][0]:
                    tree[r] = value
                r += r & -r
            nth += 1
        best, r = (0.0, -1), int(np.searchsorted(ends, a))
        while r:
            if tree[r][0] > best[0]:
                best = tree[r]
            r -= r & -r
        gain[i] = GAIN * n - SKIP * 2 * (q - p)
        cost = best[0] - SKIP * (p + a)
        if best[1] >= 0 and cost > 0:
            gain[i], before[i] = gain[i] + cost, best[1]
    used, out = [False] * len(parts), []
    for i in sorted(range(len(parts)), key=lambda i: -gain[i]):
        chain, n = [], 0
        while i >= 0 and not used[i]:
            used[i], n = True, n + parts[i][4]
            chain = [parts[i][:2], parts[i][2:4], *chain]
            i = before[i]
        if n > 1:
            out.append(chain)
    return out


def _outwards(a: np.ndarray, b: np.ndarray) -> tuple[int, int, bool]:
    """How far two texts agree from their starts on, place by place, in how many words, and whether more words could change this."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    score = np.cumsum(np.where(same, 1, -2))
    if not n:
        return 0, 0, True
    fallen = np.maximum.accumulate(np.maximum(score, 0)) - score > DROP
    stop = int(fallen.argmax()) if fallen.any() else n
    length = int(score[:stop].argmax()) + 1 if stop and score[:stop].max() > 0 else 0
    return length, int(same[:length].sum()), not fallen.any()


def _jump(x: np.ndarray, y: np.ndarray) -> int:
    """How many words of two texts agree, aligned from their starts up to some place and from there on from their ends."""
    n = min(len(x), len(y))
    head = np.concatenate([[0], np.cumsum(x[:n] == y[:n])])
    tail = np.concatenate([np.cumsum((x[len(x) - n :] == y[len(y) - n :])[::-1])[::-1], [0]])
    return int((head + tail).max())


def aligned(chain: list[tuple[int, int]], here: np.ndarray, there: np.ndarray) -> tuple[int, int, int, int, float, bool, bool]:
    """Start and length here and there of a chain's passage, the share of its words that agree, and whether more words to the left, or to the right, could change
    it. The last point of a chain is the start of K words."""
    (p, a), (q, b) = chain[0], chain[-1]
    left, agree, open_left = _outwards(here[:p][::-1], there[:a][::-1])
    right, more, open_right = _outwards(here[q + K :], there[b + K :])
    agree += more + int((here[q : q + K] == there[b : b + K]).sum())
    for (p1, a1), (p2, a2) in zip(chain, chain[1:]):
        agree += _jump(here[p1:p2], there[a1:a2])
    n, m = q + K + right - (p - left), b + K + right - (a - left)
    return p - left, n, a - left, m, min(1.0, agree / max(n, m)), open_left, open_right


def _runs(places: np.ndarray, least: int, n: int) -> list[tuple[int, int]]:
    """First and last start of the stretches of ``least`` words that can be equal, given the ascending places of shared seeds in a text of n words: such a stretch has
    seeds among its first WINDOW places and its last, and no step between them is over WINDOW."""
    cuts_ = np.nonzero(np.diff(places) > WINDOW)[0] + 1
    ends = [(int(x[0]) - WINDOW + 1, min(int(x[-1]) - (least - K - WINDOW + 1), n - least)) for x in np.split(places, cuts_) if len(x)]
    return [(max(0, a), b) for a, b in ends if b >= max(0, a)]


def _uncovered(places: np.ndarray, spans: list[tuple[int, int]], least: int, n: int) -> np.ndarray:
    """Which of the seeds at these places, ascending, lie in a stretch of ``least`` words that can be equal and is in no one span (start, length)."""
    out = np.zeros(len(places) + 1, np.int64)
    for a, b in _runs(places, least, n):
        open_ = np.ones(b - a + 1, bool)
        for start, length in spans:
            open_[max(0, start - a) : max(0, start + length - least - a + 1)] = False
        s = np.nonzero(open_)[0] + a
        np.add.at(out, np.searchsorted(places, s), 1)
        np.add.at(out, np.searchsorted(places, s + least - K, "right"), -1)
    return np.cumsum(out[:-1]) > 0


def _stretches(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in one pass."""
    base = 0x9E3779B97F4A7C15
    up = np.cumprod(np.full(len(words), base, np.uint64))
    down = np.cumprod(np.full(len(words), pow(base, -1, 1 << 64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up)])
    return mixed((sums[n:] - sums[:-n]) * down[: len(words) - n + 1])


# --- seeds that several documents have ----------------------------------------------------------------------------------------------------

_CHUNKS = "chunk long, doc_ids array<long>, sizes array<int>, hashes binary, texts binary, places binary, n long"
SEEDS = "h long, doc_id long, p int, n_words int"


def _chunks(docs: DataFrame) -> DataFrame:
    """Seeds of the texts of about CHUNK_WORDS words in each row, by hash."""
    names = ["chunk", "doc_ids", "sizes", "hashes", "texts", "places", "n"]

    def run(batches):
        part, nth = TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0

        def closed():
            h, of, at = seeds(texts)
            order = np.lexsort((at, of, h))
            values = [[part << 32 | nth], [ids], [[len(x) for x in texts]], [packed_sorted((h[order] ^ (np.uint64(1) << np.uint64(63))).view(np.int64))], [packed(of[order])], [packed(at[order])], [len(h)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names=names)

        for batch in batches:
            for doc, words in zip(batch.column(0).to_pylist(), hashed(x.as_py() for x in batch.column(1))):
                ids.append(doc)
                texts.append(words)
                held += len(texts[-1])
                if held >= CHUNK_WORDS:
                    yield closed()
                    nth, ids, texts, held = nth + 1, [], [], 0
        if ids:
            yield closed()

    return docs.mapInArrow(run, _CHUNKS)


def _hashes(row: dict) -> np.ndarray:
    """The hashes of a chunk's seeds, ascending."""
    return unpacked_sorted(row["hashes"]).view(np.uint64) ^ (np.uint64(1) << np.uint64(63))


def _distinct(h: np.ndarray) -> np.ndarray:
    """Where each distinct one of ascending hashes begins."""
    return np.nonzero(np.concatenate([[True], h[1:] != h[:-1]]))[0] if len(h) else np.zeros(0, np.int64)


def _ranges(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return cuts((h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64))


def shared_seeds(docs: DataFrame) -> DataFrame:
    """The seeds (h, doc_id, p, n_words of the text) that more than one document has."""
    chunks = staged(_chunks(docs), "chunks")
    n = chunks.agg(F.sum("n")).first()[0] or 0
    bits = max(0, (n // BUCKET).bit_length())

    def asking(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h, ids = _hashes(row), np.array(row["doc_ids"], np.int64)
                doc = ids[unpacked(row["texts"])]
                first = _distinct(h)
                several = np.maximum.reduceat(doc, first) != np.minimum.reduceat(doc, first) if len(h) else np.zeros(0, bool)
                least = doc[first]  # of one document only, unless several
                present, starts = _ranges(h[first], bits)
                for to, k, s, d in zip(present, np.split(h[first], starts), np.split(several, starts), np.split(least, starts)):
                    yield from posted([{"to": int(to), "sender": row["chunk"], "kind": ASKED, "a": packed_sorted((k ^ (np.uint64(1) << np.uint64(63))).view(np.int64)), "b": np.packbits(s).tobytes(), "c": packed(d)}])

    def answering(group: pa.Table) -> pa.Table:
        asked = letters(group, ASKED)
        keys = [unpacked_sorted(x["a"]) for x in asked]
        several = np.concatenate([np.unpackbits(np.frombuffer(x["b"], np.uint8), count=len(k)) for x, k in zip(asked, keys)]).astype(bool)
        docs_ = np.concatenate([unpacked(x["c"]) for x in asked])
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        start = _distinct(flat[order])
        both = np.logical_or.reduceat(several[order], start) | (np.maximum.reduceat(docs_[order], start) != np.minimum.reduceat(docs_[order], start))
        told = np.empty(len(flat), bool)
        told[order] = np.repeat(both, np.diff(np.concatenate([start, [len(flat)]])))
        return post([{"to": x["sender"], "sender": x["to"], "kind": SHARED, "a": np.packbits(t).tobytes()} for x, t in zip(asked, np.split(told, np.cumsum([len(k) for k in keys])[:-1]))])

    def choosing(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("p", pa.int32()), ("n_words", pa.int32())]).empty_table()]
        for row in left.to_pylist():
            h = _hashes(row)
            first = _distinct(h)
            if not len(h):
                continue
            sizes = np.diff(np.concatenate([first, [len(h)]]))
            _, starts = _ranges(h[first], bits)
            counts = np.diff(np.concatenate([[0], starts, [len(first)]]))
            told = np.concatenate([np.unpackbits(np.frombuffer(x["a"], np.uint8), count=int(n)) for x, n in zip(letters(right, SHARED), counts)]).astype(bool)
            at = np.nonzero(np.repeat(told, sizes))[0]
            of = unpacked(row["texts"])[at]
            out.append(pa.table({"h": h[at].view(np.int64), "doc_id": np.array(row["doc_ids"], np.int64)[of], "p": unpacked(row["places"])[at].astype(np.int32), "n_words": np.array(row["sizes"], np.int32)[of]}))
        return pa.concat_tables(out)

    answers = chunks.select("chunk", "doc_ids", "hashes", "texts").mapInArrow(asking, MAIL).groupBy("to").applyInArrow(answering, MAIL)
    out = staged(chunks.groupBy("chunk").cogroup(answers.groupBy("to")).applyInArrow(choosing, SEEDS), "seeds")
    discard(chunks)
    return out


# --- passages -----------------------------------------------------------------------------------------------------------------------------

_CHAINS = "doc_id long, other long, p long, a long, chain array<int>"
_CHAIN_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))


def _rows(rows: list[tuple], kinds, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=list(names))


def _flat(chain: list[tuple[int, int]]) -> list[int]:
    return [x for point in chain for x in point]


def _offsets(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """To which list each item belongs, and the items."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()


def _short(words: np.ndarray) -> bytes:
    """The lowest 40 bits of words' hashes, by which an alignment tells words apart."""
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _chained(batches):
    """Chains of the links of pairs of documents."""
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, other = batch.column("doc_id").to_pylist(), batch.column("other").to_pylist()
        pair, links = _offsets(batch.column("links"))
        rows = segments(pair, links.field(0).to_numpy().astype(np.int64), links.field(1).to_numpy().astype(np.int64))
        out = []
        starts = _distinct(rows[:, 0])
        for part in np.split(rows, starts[1:]):
            i = int(part[0, 0])
            for chain in chains([tuple(x[1:]) for x in part.tolist()]):
                out.append((doc[i], other[i], *chain[0], _flat(chain)))
        yield _rows(out, _CHAIN_KINDS, ("doc_id", "other", "p", "a", "chain"))


def _aligned(docs: DataFrame, found: DataFrame, least: int, identity: float, margin: int | None) -> DataFrame:
    """Passages of chains, from the words of each chain and ``margin`` words around it (None: all), with the chain where more words could change them."""
    spare = 1 << 40 if margin is None else margin
    ends = lambda side: F.struct(F.lit(side).alias("side"), "doc_id", "other", "p", "a", "chain")
    needs = found.select(F.explode(F.array(F.struct(F.col("doc_id").alias("id"), ends(0).alias("n")), F.struct(F.col("other").alias("id"), ends(1).alias("n")))).alias("e"))
    needs = needs.select("e.id", "e.n")
    # a document that very many others have parts of is read once for each NEEDS of them
    parts = needs.groupBy("id").agg(F.ceil(F.count("*") / NEEDS).alias("parts"))
    needs = needs.join(parts.hint("merge"), "id").groupBy("id", F.pmod(F.xxhash64("n.doc_id", "n.p"), "parts").alias("part")).agg(F.collect_list("n").alias("needs"))
    names = ("doc_id", "other", "p", "a", "chain", "side", "version", "low", "n_words", "words")

    def sliced(batches):
        for batch in batches:
            of, needs = _offsets(batch.column("needs"))
            side, chain = needs.field("side").to_numpy(), needs.field("chain")
            steps, points = chain.offsets.to_numpy(), chain.values.to_numpy().astype(np.int64)
            low, high = np.maximum(0, points[steps[:-1] + side] - spare), points[steps[1:] - 2 + side] + K + spare
            columns = [*(needs.field(c) for c in ("doc_id", "other", "p", "a")), chain.take(pa.array(np.arange(len(side)), mask=side != 0)), needs.field("side")]
            ends, sizes = np.searchsorted(of, np.arange(batch.num_rows), "right"), np.zeros(batch.num_rows, np.int64)
            start, at, out, held = 0, 0, [], 0
            for i, words in enumerate(hashed(x.as_py() for x in batch.column("text"))):
                sizes[i], raw, end = len(words), _short(words), int(ends[i])
                out += [raw[5 * x : 5 * y] for x, y in zip(low[at:end].tolist(), high[at:end].tolist())]
                held, at = held + sum(map(len, out[at - start :])), end
                if held > 1 << 24 or i + 1 == batch.num_rows:
                    some = of[start:at]
                    more = [batch.column("version").take(pa.array(some)), pa.array(low[start:at]), pa.array(sizes[some]), pa.array(out, pa.binary())]
                    yield pa.RecordBatch.from_arrays([*(c[start:at] for c in columns), *more], names=list(names))
                    start, out, held = at, [], 0

    def placed(batches):
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                (low, total, here), (low_, total_, there) = ((s["low"], s["n_words"], _long(s["words"])) for s in (x["here"], x["there"]))
                chain = list(zip(x["chain"][::2], x["chain"][1::2]))
                start, n, at, m, share, left, right = aligned([(p - low, a - low_) for p, a in chain], here, there)
                # the slices' ends settle nothing unless they are ends of a text
                short = (left and low > 0 and low_ > 0) or (right and low + len(here) < total and low_ + len(there) < total_)
                if short or (n >= least and share >= identity):
                    out.append((x["doc_id"], start + low, n, x["other"], at + low_, m, share, x["chain"] if short else None))
            yield _rows(out, (*[pa.int64()] * 6, pa.float64(), pa.list_(pa.int32())), ("doc_id", "start", "length", "source_doc_id", "source_start", "source_length", "identity", "chain"))

    rows = docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("version")).join(needs.hint("merge"), "id").select("text", "version", "needs")
    slices = rows.mapInArrow(sliced, f"{_CHAINS}, side int, version long, low long, n_words long, words binary")
    side = lambda k: F.min(F.when(F.col("side") == k, F.struct("version", "low", "n_words", "words")))
    both = slices.groupBy("doc_id", "other", "p", "a").agg(F.max("chain").alias("chain"), side(0).alias("here"), side(1).alias("there"))
    return both.mapInArrow(placed, f"{PASSAGES}, chain array<int>")


def _placed(docs: DataFrame, found: DataFrame, least: int, identity: float) -> DataFrame:
    """Passages of chains."""
    first = staged(_aligned(docs, found, least, identity, MARGIN), "aligned")
    discard(found)
    release(docs.sparkSession)
    again = first.where("chain is not null").select("doc_id", F.col("source_doc_id").alias("other"), F.col("chain")[0].cast("long").alias("p"), F.col("chain")[1].cast("long").alias("a"), "chain")
    return first.where("chain is null").unionByName(_aligned(docs, again, least, identity, None)).drop("chain").distinct()


def passages(docs: DataFrame, least: int = LEAST, identity: float = IDENTITY) -> DataFrame:
    """One row for each passage of a document that an earlier document has."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")

    def rest(batches):
        for batch in batches:
            out = [np.zeros(0, np.int64)]
            for flat, spans, n in zip(*(batch.column(c) for c in ("seeds", "spans", "n_words"))):
                at, h = flat.values.field(0).to_numpy().astype(np.int64), flat.values.field(1).to_numpy()
                order = np.lexsort((h, at))
                out.append(h[order][_uncovered(at[order], [(s["start"], s["length"]) for s in spans.as_py() or ()], least, n.as_py())])
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(out)))], names=["h"])

    def whole(batches):
        for batch in batches:
            rows = [(np.zeros(0, np.int64),) * 3]
            for doc, words, places in zip(batch.column("doc_id").to_pylist(), hashed(x.as_py() for x in batch.column("text")), batch.column("places").to_pylist()):
                if len(words) >= least:
                    all_ = _stretches(words, least)
                    at = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.arange(a, min(b + 1, len(all_))) for a, b in _runs(np.sort(np.array(places, np.int64)), least, len(words))]]))
                    rows.append((all_[at].view(np.int64), np.full(len(at), doc, np.int64), at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([r[i] for r in rows])) for i in range(3)], names=["g", "doc_id", "p"])

    def joined(batches):
        """Passages of stretches that are whole in one other document and lie in no passage so far: of overlapping ones those that reach furthest, as
        repeated words make many."""
        for batch in batches:
            rows = []
            for doc, other, links, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "other", "links", "spans"))):
                at = sorted({(x["a"] - x["p"], x["p"]) for x in links})
                runs, i = [], 0
                for j in range(1, len(at) + 1):
                    if j == len(at) or at[j] != (at[j - 1][0], at[j - 1][1] + 1):
                        start, end = at[i][1], at[j - 1][1] + least
                        if not any(s["start"] <= start and end <= s["start"] + s["length"] for s in spans or ()):
                            runs.append((start, end, at[i][0]))
                        i = j
                covered, best = -1, None
                for start, end, shift in [*sorted(runs), (1 << 60, 0, 0)]:
                    if best and start > covered:  # none that begins later reaches further than the best so far without a gap
                        rows.append((doc, best[0], best[1] - best[0], other, best[0] + best[2], best[1] - best[0], 1.0))
                        covered, best = best[1], None
                    if end > covered and (best is None or end > best[1]):
                        best = (start, end, shift)
            yield _rows(rows, (*[pa.int64()] * 6, pa.float64()), ("doc_id", "start", "length", "source_doc_id", "source_start", "source_length", "identity"))

    seeds_ = shared_seeds(docs)
    release(spark)
    # a seed with very many places is dealt into parts, in each of which a place has its last document before
    firsts = seeds_.groupBy("h").agg(F.min(F.struct("doc_id", "p")).alias("f"), F.ceil(F.count("*") / PART).alias("parts"))
    dealt = seeds_.join(firsts.hint("merge"), "h").select("h", "doc_id", "p", "n_words", F.col("f.doc_id").alias("first"), F.col("f.p").alias("a"), F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"))
    earlier = Window.partitionBy("h", "part").orderBy("doc_id").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.struct(F.col("doc_id"), (-F.col("p")).alias("p"))).over(earlier)
    shared = dealt.repartition("h", "part").select("h", "doc_id", "p", "n_words", "first", "a", last.alias("b"))
    shared = staged(shared.select("h", "doc_id", "p", "n_words", "first", "a", F.col("b.doc_id").alias("before"), (-F.col("b.p")).alias("c")).where("doc_id > first"), "shared")
    release(spark)
    ends = F.array(F.struct(F.col("first").alias("other"), "a"), F.when(F.col("first") != F.col("before"), F.struct(F.col("before").alias("other"), F.col("c").alias("a"))))
    links = shared.select("doc_id", "p", F.explode(F.array_compact(ends)).alias("e")).select("doc_id", "p", "e.*").groupBy("doc_id", "other").agg(F.collect_list(F.struct("p", "a")).alias("links")).where(F.size("links") > 1)
    found = staged(links.mapInArrow(_chained, _CHAINS), "chains")
    del links
    release(spark)
    out = staged(_placed(docs, found, least, identity), "passages")
    release(spark)
    if least < K + WINDOW:
        return out
    later = shared.groupBy("doc_id").agg(F.collect_list(F.struct("p", "h")).alias("seeds"), F.max("n_words").alias("n_words")).where(F.size("seeds") > 1)
    spans = out.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    left = staged(later.join(spans, "doc_id", "left").select("seeds", "spans", "n_words").mapInArrow(rest, "h long").distinct(), "rest")
    release(spark)
    places = seeds_.join(left, "h", "left_semi").groupBy("doc_id").agg(F.collect_list("p").alias("places")).where(F.size("places") > 1)
    runs = staged(docs.join(places, "doc_id").select("doc_id", "text", "places").mapInArrow(whole, "g long, doc_id long, p long"), "runs")
    release(spark)
    sources = runs.groupBy("g").agg(F.min(F.struct(F.col("doc_id").alias("other"), F.col("p").alias("a"))).alias("f"), F.max("doc_id").alias("last")).where("f.other < last").select("g", "f.*")
    again = runs.join(sources, "g").where("doc_id > other").groupBy("doc_id", "other").agg(F.collect_list(F.struct("p", "a")).alias("links"))
    return out.unionByName(again.join(spans, "doc_id", "left").select("doc_id", "other", "links", "spans").mapInArrow(joined, PASSAGES)).distinct()


_WORD = re.compile(r"\S+")


def cut(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the passages that earlier documents have, and without documents of which no word is left."""
    spans = found.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("start", "length")).alias("_spans"))
    version = F.xxhash64(F.col("text").cast("string"))
    # of rows that repeat a doc_id, passages are those of the text with the least hash
    versions = docs.select(F.col("doc_id").cast("long").alias("_id"), version.alias("_version")).groupBy("_id").agg(F.min("_version").alias("_version"))
    joined = docs.join(spans.join(versions, "_id"), (F.col("doc_id") == F.col("_id")) & (version == F.col("_version")), "left").drop("_id", "_version")

    def left(text: str, spans: list[dict]) -> str:
        words = list(_WORD.finditer(text))
        gone = np.zeros(len(words), bool)
        for s in spans:
            gone[s["start"] : s["start"] + s["length"]] = True
        out, at = [], 0
        for i in np.nonzero(gone)[0]:
            out.append(text[at : words[i].start()])
            at = words[i + 1].start() if i + 1 < len(words) else len(text)
        return "".join([*out, text[at:]]).rstrip() if gone.any() else text

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [left(x, s) if s else x for x, s in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist())]
            out = batch.set_column(at, "text", pa.array(texts, pa.string()))
            yield out.drop_columns(["_spans"])

    changed = joined.where("_spans is not null").mapInArrow(run, docs.select(*[c for c in joined.columns if c != "_spans"]).schema).where(F.length(F.trim("text")) > 0)
    changed = changed.select(*docs.columns)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"]))
    return joined.where("_spans is null").select(*docs.columns).unionByName(changed)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents"))
