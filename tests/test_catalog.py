"""Every query with SQL gives what DuckDB gives; names, merges and paths follow their rules on small cases."""

import itertools
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from stratalog.functions import addresses, areas, commands, grammar, names, patterns, phrases
from stratalog.operators import catalogs, mutations, sentences, side_tables
from stratalog.plans import registry
from stratalog.streaming import changes

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(found, columns):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, con, name):
    made = registry.queries()[name](spark, DATA)
    want = con.sql(registry.oracle_sql()[name])
    columns = sorted(made.columns)
    assert columns == sorted(want.columns)
    assert rows(made.select(*columns).collect(), columns) == rows(want.select(*[f'"{c}"' for c in columns]).fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["rank", "id", "name", "tier"]
    assert set(registry.queries()) <= set(entry.queries())


def test_word_starts_and_tiers(spark):
    df = spark.createDataFrame([("XMLHttpRequest-test.rs",), ("ahttp",), ("http",), ("http.txt",), ("Straße",), ("STRASSE.txt",), ("xstrasse",)], "name string")
    parts = df.where("name like 'XML%'").select(names.word_parts(F.col("name"))).first()[0]
    assert parts == ["XML", "Http", "Request-", "test.", "rs"]
    tiers = {r.name: r.t for r in df.select("name", names.tier(F.col("name"), "http").alias("t")).collect()}
    assert (tiers["http"], tiers["http.txt"], tiers["XMLHttpRequest-test.rs"], tiers["ahttp"]) == (0, 1, 2, 3)
    tiers = {r.name: r.t for r in df.select("name", names.tier(F.col("name"), "STRASSE").alias("t")).collect()}
    beyond = df.sparkSession.createDataFrame([("a-Straße",), ("École",), ("E\u0301cole",), ("東京.txt",)], "name string")
    assert [r.t for r in beyond.select(names.tier(F.col("name"), "strasse").alias("t")).collect()] == [2, None, None, None]
    assert [r.t for r in beyond.select(names.tier(F.col("name"), "école").alias("t")).collect()] == [None, 0, 0, None]
    assert (tiers["Straße"], tiers["STRASSE.txt"], tiers["xstrasse"], tiers["http"]) == (0, 1, 3, None)


def test_kinds_and_extensions_of_dot_files(spark):
    df = spark.createDataFrame([(".png",), ("a.PNG",), ("a.",), ("plain",), (".bashrc",)], "name string")
    got = [tuple(r) for r in df.select(names.kind(F.col("name"), F.lit(False)), names.extension(F.col("name")), names.family(F.col("name"))).collect()]
    assert got == [("Image", None, "File"), ("Image", "png", "Image"), ("Other", "", "File"), ("Other", None, "File"), ("Other", None, "File")]


def test_sizes_round_halves_to_even(spark, con):
    draw = random.Random(7)
    sizes = [0, 1023, 1024, 1280, 1792, 1048575, 1048576, 2**40 - 1, 2**40, 2**62 + 2**60]
    for unit in (2**10, 2**20, 2**30, 2**40):
        sizes += [unit * k // 4 + d for k in (5, 7, 9, 4093, 4095) for d in (-1, 0, 1)] + [draw.randrange(unit, 1024 * unit) for _ in range(500)]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", names.format_size(F.col("n"))).collect()
    for n, label in got:
        i = min(max(n.bit_length() - 1, 0) // 10, 4)
        assert label == (f"{n / 1024**i:.1f} {'KB MB GB TB'.split()[i - 1]}" if i else f"{n} B")
        if 1024 <= n < 2**40:
            assert label[:-3] == con.execute("SELECT printf('%.1f', ? / ?::DOUBLE)", [n, 1024.0**i]).fetchone()[0]


def test_edits():
    assert names.swaps_distance("report", "rpeort", 2) == 1
    assert names.swaps_distance("ca", "abc", 3) == 3
    assert names.swaps_distance("abc", "xyzw", 2) == 3


def test_deleting_a_directory_hides_what_is_below(spark):
    schema = "level int, op string, id long, parent long, root long, name string, is_dir boolean, size long, mtime long"
    levels = [
        (0, "upsert", 1, 0, 1, "r", True, None, None), (0, "upsert", 2, 1, 1, "d", True, None, None), (0, "upsert", 3, 2, 1, "f", False, 5, 1),
        (0, "upsert", 4, 1, 1, "g", False, 6, 1), (1, "delete", 2, 1, 1, "d", True, None, None), (1, "upsert", 4, 1, 1, "h", False, 7, 1),
    ]
    live = catalogs.live(spark.createDataFrame(levels, schema))
    assert sorted((r.id, r.name) for r in live.collect()) == [(1, "r"), (4, "h")]


def test_no_required_tags_match_nothing(spark):
    tags = spark.createDataFrame([("a", "x"), ("a", "Y"), ("b", "x")], "path string, tag string")
    assert side_tables.with_all_tags(tags, []).count() == 0
    assert [r.path for r in side_tables.with_all_tags(tags, ["X", "y"]).collect()] == ["a"]


def test_free_names(spark):
    files = spark.createDataFrame([("/a/x.txt",), ("/b/x.txt",), ("/c/x 2.txt",), ("/d/.rc",), ("/in/x.txt",), ("/in",)], "path string")
    disk = spark.createDataFrame([("x 3.txt",), (".rc",)], "name string")
    got = {p: {r.path: r.target for r in mutations.transfers(files, "/in/", disk, p).collect()} for p in ("keep_both", "skip", "replace")}
    assert got["keep_both"] == {"/a/x.txt": "/in/x.txt", "/b/x.txt": "/in/x 2.txt", "/c/x 2.txt": "/in/x 2 2.txt", "/d/.rc": "/in/.rc 2"}
    assert got["skip"] == {k: v for k, v in got["keep_both"].items() if k != "/d/.rc"}
    assert got["replace"]["/d/.rc"] == "/in/.rc"
    with pytest.raises(ValueError):
        mutations.transfers(files, "/in", disk, "guess")


def test_free_names_beyond_ten_thousand(spark):
    files = spark.range(10_010).select(F.format_string("/%05d/x.txt", "id").alias("path"))
    disk = spark.createDataFrame([("x 10000.txt",)], "name string")
    got = [r.target for r in mutations.transfers(files, "/in", disk).orderBy("path").collect()]
    assert got == ["/in/x.txt"] + [f"/in/x {n}.txt" for n in range(2, 10_012) if n != 10_000]


@pytest.mark.parametrize("policy", ["keep_both", "skip", "replace"])
def test_free_names_equal_those_taken_one_by_one(spark, policy):
    draw = random.Random(5)
    stems = ["x", "x 2", "x 3", "x 02", "x 1", "x 2 2", "x 2 3", "a\nb", "a\nb 2", "x 2\n", "x 2\n 2", " 2", ".rc", ".rc 2"]
    leaves = [stem + ext for stem in stems for ext in ("", ".e", ".")]
    paths = [f"/{n:03d}/{draw.choice(leaves)}" for n in range(700)]
    disk = draw.sample(leaves, 9) + ["x 5", "x 7.e", "x 2 4.", "x 8."]
    taken, want = set(), {}
    for path in paths:
        name = path.split("/")[2]
        if name in disk and policy == "skip":
            continue
        dot = name.rfind(".") if name.rfind(".") > 0 else len(name)
        tried = itertools.chain([name], (f"{name[:dot]} {n}{name[dot:]}" for n in itertools.count(2)))
        free = next(t for t in tried if t not in taken and (t not in disk or (policy == "replace" and t == name)))
        taken.add(free)
        want[path] = "/in/" + free
    made = mutations.transfers(spark.createDataFrame([(p,) for p in paths], "path string"), "/in", spark.createDataFrame([(n,) for n in disk], "name string"), policy)
    assert {r.path: r.target for r in made.collect()} == want


def test_remapping_replaces_what_was_there(spark):
    entries = spark.createDataFrame([("/a", 1), ("/a/b", 2), ("/ab", 3), ("/c/b", 4)], "path string, icon int")
    assert sorted(map(tuple, mutations.remapped(entries, "/a", "/c").collect())) == [("/ab", 3), ("/c", 1), ("/c/b", 2)]
    assert sorted(map(tuple, mutations.remapped(entries, "/a", "/c", copy=True).collect())) == [("/a", 1), ("/a/b", 2), ("/ab", 3), ("/c", 1), ("/c/b", 2)]


def test_streamed_batches_can_run_again(spark, tmp_path):
    schema = "sequence long, op string, id long, parent long, root long, name string, is_dir boolean, size long, mtime long"
    base = spark.createDataFrame([(1, 0, 1, "r", True, None, None), (2, 1, 1, "f", False, 1, 1), (3, 1, 1, "g", False, 1, 1)], schema.split("op string, ")[1])
    for n, rows_ in enumerate([[(1, "upsert", 2, 1, 1, "old", False, 2, 1), (2, "upsert", 2, 1, 1, "new", False, 3, 1)], [(3, "delete", 3, 1, 1, "g", False, None, None)]]):
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
        for state in ("state", f"again{n}"):  # a fresh state reads all from the first on, as batch 0
            changes.ingest(stream, str(tmp_path / "levels"), str(tmp_path / state)).awaitTermination()
    assert sorted((r.id, r.name) for r in changes.current(spark, base, str(tmp_path / "levels")).collect()) == [(1, "r"), (2, "new")]


def test_bursts_and_first_sightings_of_a_stream(spark, tmp_path):
    rows_ = [("a", "2024-01-01 00:00:00", "1"), ("a", "2024-01-01 00:00:01", "1"), ("a", "2024-01-01 00:01:00", "2")]
    seen = spark.createDataFrame(rows_, "k string, t string, operation_id string").withColumn("t", F.to_timestamp("t"))
    seen.write.parquet(str(tmp_path / "in"))
    assert sorted(r.n for r in changes.bursts(seen, "k", "t", "5 seconds", "1 minute").collect()) == [1, 2]
    stream = spark.readStream.schema(seen.schema).parquet(str(tmp_path / "in"))
    changes.first_sightings(stream, "t", "1 hour").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.operation_id for r in spark.table("firsts").collect()) == ["1", "2"]


def test_deep_records_orphans_and_circles(spark):
    rows = [(1, 0, 1, "top", True)] + [(i, i - 1, 1, f"d{i}", True) for i in range(2, 41)] + [(50, 40, 1, "leaf.txt", False), (60, 99, 1, "orphan", True), (61, 60, 1, "x", False), (70, 71, 1, "a", True), (71, 70, 1, "b", True)]
    records = spark.createDataFrame(rows, "id long, parent long, root long, name string, is_dir boolean")
    got = {r.id: r.path for r in catalogs.with_paths(records).collect()}
    assert set(got) == {*range(1, 41), 50} and got[50] == "/top/" + "/".join(f"d{i}" for i in range(2, 41)) + "/leaf.txt"
    levels = records.selectExpr("0 as level", "'upsert' as op", "*")
    gone = levels.where("id = 20").selectExpr("1 as level", "'delete' as op", "id", "parent", "root", "name", "is_dir")
    assert {r.id for r in catalogs.live(levels.unionByName(gone)).collect()} == set(range(1, 20))


def test_scrubbed_words(spark):
    texts = {"(\"/a/b/c\"),": "<path>", "`/a/b`": "<path>", "//x": "<path>", "[/a/b]": "[/a/b]", "see /etc C:\\x c:/y now\n": "see /etc <path> <path> now", "/home/me/x y\r\nz": "~/x y\nz", "": ""}
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "t string, want string")
    assert [tuple(r) for r in df.select(names.scrubbed(F.col("t"), "/home/me"), "want").collect()] == [(v, v) for v in texts.values()]


def test_chips_and_names_that_resemble(spark):
    raw = "a size:>1k  size:>1024 b kind:zip"
    assert [w for w, _ in grammar.chips(raw, 0)] == ["size:>1k", "kind:zip"] and grammar.without(raw, "b") == "a size:>1k size:>1024 kind:zip" and grammar.parsed(raw, 0).text == "a b"
    df = spark.createDataFrame([("XMLHttpRequest.rs",), ("my-report.txt",), ("my-reprot.txt",), ("rapport",), ("École-x",)], "name string")
    like = lambda q: [r.name for r in df.where(names.resembles(F.col("name"), q)).collect()]
    assert like("xhr") == ["XMLHttpRequest.rs"] and like("repor") == ["my-report.txt"] and like("ecole") == ["École-x"] and like("x") == []



def test_shares_mounts_and_codes(spark):
    texts = [r" \\nas\share\\a ", r"\\?\C:\x", r"\\nas", "smb://me@nas/a%20b/", "cifs://@nas/a", "nfs://nas", "smb://nas", "smb://nas/%zz", "smb://%ff/a", "//nas/a", "http://nas/a", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", addresses.share(F.col("t")).alias("a"))
    found = {r.i: r.a and tuple(r.a) for r in df.collect()}
    assert found[0] == ("smb", "nas", None, ["share", "a"]) and found[3] == ("smb", "nas", "me", ["a b"]) and found[4] == ("smb", "nas", None, ["a"])
    assert found[5] == ("nfs", "nas", None, []) and all(found[i] is None for i in (1, 2, 6, 7, 8, 9, 10, 11, 12))
    sources = [("//DOM;me@nas/a%20b", "smbfs"), ("//nas/a%20b", "cifs"), ("[fe80::1]:/x/y", "nfs4"), ("/dev/sda", "ext4"), ("//nas", "cifs")]
    got = spark.createDataFrame(sources, "s string, k string").select(addresses.mounted_share(F.col("s"), F.col("k")).alias("a")).collect()
    assert [r.a and tuple(r.a) for r in got] == [("smb", "nas", "me", ["a b"]), ("smb", "nas", None, ["a%20b"]), ("nfs", "fe80::1", None, ["x", "y"]), None, None]
    lines = [(1, "/dev/a /m\\040x ext4 rw"), (2, "/dev/b /m\\040x ext4 rw"), (3, "proc /proc proc"), (4, "short line"), (5, ""), (6, "x\\\\040y /n\\303\\251\\9 fuse.sshfs"), (7, None)]
    got = addresses.mounts(spark.createDataFrame(lines, "line int, text string")).collect()
    assert {(r.line, r.source, r.mount) for r in got} == {(1, "/dev/a", "/m x"), (6, "x\\ y", "/né\\9")}
    codes = spark.createDataFrame([("a%41+",), ("%",), ("%4",), ("%c3%a9",), ("%c3",), ("",), (None,)], "t string").select(addresses.percent_decode(F.col("t")).alias("x"))
    assert [r.x for r in codes.collect()] == ["aA+", None, None, "é", None, "", None]


def test_name_patterns(spark):
    assert [patterns.parsed(t) for t in ("", "{nmae}", "a{n", "a}b", "{n}}")] == [None] * 5
    assert patterns.parsed("{ Name }").varies and not patterns.parsed("x.{ext}").varies
    df = spark.createDataFrame([("a.tar.gz",), (".bashrc",), ("a.",), ("plain",)], "name string")
    got = df.select(patterns.parsed("{n}-{name}|{ext}").render(F.col("name"), F.lit(123), F.lit(2)).alias("x")).collect()
    assert [r.x for r in got] == ["123-a.tar|gz", "123-.bashrc|", "123-a|", "123-plain|"]


def test_nearest_words():
    assert names.nearest("pitcures", ["pictures", "music"]) == "pictures" and names.nearest("music", ["music", "musics"]) is None
    assert names.nearest("cot", ["cat", "dot"]) == "cat" and names.nearest("cot", ["cat", "cut"]) is None and names.nearest("cot", ["dot", "got"]) is None


def test_tag_sets(spark):
    df = spark.createDataFrame([([("a", "Red"), ("b", None), ("a", None), ("c", None)],), ([],)], "tags array<struct<name:string,color:string>>")
    tag = lambda x: side_tables.system_tag(F.lit(x))
    shown = lambda c: [[(t.name, t.color) for t in r[0]] for r in df.select(c).collect()]
    assert shown(side_tables.with_tag(F.col("tags"), tag("b\n2"))) == [[("a", "Red"), ("a", None), ("c", None), ("b", "Green")], [("b", "Green")]]
    assert shown(side_tables.with_tag(F.col("tags"), tag("c\n0"), F.lit("a"))) == [[("c", None), ("b", None)], [("c", None)]]
    assert shown(side_tables.with_tag(F.col("tags"), tag("x\n8"), F.lit("no")))[1] == [("x\n8", None)]
    assert shown(side_tables.without_tag(F.col("tags"), F.lit("A")))[0] == [("b", None), ("c", None)] and shown(side_tables.without_tag(F.col("tags"))) == [[], []]


def test_areas_and_descriptions(spark):
    paths = [("/r", True), ("/r/USR/x", False), ("/r/a/usr", True), ("/r/a/target/x", False), ("/r/a/target", True), ("/r/a/target2", True), ("/r/b/target", False), ("/r/net/x", False), ("/s/usr", True)]
    df = spark.createDataFrame(paths, "path string, is_dir boolean")
    got = df.select(areas.excluded(F.col("path"), F.col("is_dir"), "/r", ("target",), ("/r/net", "/r", "/")).alias("x")).collect()
    assert [r.x for r in got] == [False, True, False, True, True, False, False, True, False]
    named = [("LICENSE-MIT", "Plain Text"), ("readme", "Plain Text"), (".bashrc", "File"), ("a.tar.GZ", "GZ Archive"), ("x.qqq", "QQQ File"), ("x.md", "Markdown")]
    shown = spark.createDataFrame([(n,) for n, _ in named], "name string").select(names.described(F.col("name"), F.lit(False)).alias("x")).collect()
    assert [r.x for r in shown] == [x for _, x in named]


def test_refused_batches(spark):
    files = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    cases = [((), "{n}", "no matches"), (("/a", "/b"), "x.{ext}", "one name for all"), (("/a",), "..", "invalid name"), (("/a.x", "/a.y"), "{name}", "collision"), (("/a.x",), "{name}.{ext}", "nothing to do")]
    cases.append((tuple(f"/{i}" for i in range(1001)), "{n}", "too many"))
    for paths, pattern, why in cases:
        with pytest.raises(mutations.Refused, match=why):
            mutations.renamed(files(*paths), patterns.parsed(pattern))
    assert {tuple(r) for r in mutations.renamed(files("/d/b.x", "/d/a.x"), patterns.parsed("{n}")).collect()} == {("/d/a.x", "1", False), ("/d/b.x", "2", False)}


NOW = 1785067200  # 2026-07-26, a Sunday
DAY = 86400


def test_phrases():
    read = lambda raw, **k: (lambda x: (x.text, [(f.field, f.op, f.low, f.high) for f in x.filters]))(phrases.expand(raw, NOW, **k))
    today = NOW // DAY * DAY
    assert read("") == ("", []) and read("  my  ") == ("my", []) and read("photos") == ("photos", []) and read("photos", described=True)[1] == [("kind", "=", "Image", None)]
    assert read("the plan of photos of my meeting") == ("the plan meeting", [("kind", "=", "Image", None)])
    assert read("size:>1k files my photos") == ("size:>1k", [("kind", "=", "Image", None)])
    assert read("older than the photos") == ("older than", [("kind", "=", "Image", None)])
    assert read("swift opus md mp3s")[0] == "swift opus md" and read("big files")[1] == [("size", ">", 100 * 2**20, None)]
    assert read("at least a gigabyte")[1] == [("size", ">=", 2**30, None)] and read("over 1.5gb")[1] == [("size", ">", 3 * 2**29, None)] and read("over 5 parrots") == ("over 5 parrots", [])
    assert read("within a month")[1] == [("modified", ">=", NOW - 30 * DAY, None)] and read("past few hours")[1] == [("modified", ">=", NOW - 3 * 3600, None)]
    assert read("last sunday")[1] == [("modified", "range", today - 7 * DAY, today - 6 * DAY - 1)] and read("last saturday")[1] == [("modified", "range", today - DAY, today - 1)]
    assert read("after yesterday")[1] == [("modified", ">", today - 1, None)] and read("since this week")[1] == [("modified", ">=", NOW - 7 * DAY, None)]
    assert read("on feb 29") == ("29", [("modified", "range", 1769904000, 1772323199)]) and read("in december")[1][0][2] == 1764547200 and read("on 31st july")[1] == read("on july 31st")[1]
    assert read("past 999999999999999 years") == ("past 999999999999999 years", []) and read("in 1969") == ("in 1969", [])
    assert phrases.without_phrase("big Photos From last week x", "photos from") == "big last week x" and phrases.without_phrase(" a b ", "") == "a b" and phrases.without_phrase("a b", "c") == "a b"
    labels = [(p.label, p.plain_label) for p in phrases.expand("pdfs photos last week", NOW).phrases]
    assert labels == [("ext:pdf", "PDF files"), ("kind:image", "Images"), ("last week", "Last week")]


def test_commands():
    assert [commands.command(t, NOW) for t in ("", "move", "move a to", "move to b", "rename a to {x}", "organize a by color", "delete my", "tag x as")] == [None] * 8
    strict = [t for t in ("delete old logs", "delete photos", "zip photos", "move a to b", "remove tag x from y", "organize a") if commands.command(t, NOW, auto=True)]
    assert strict == ["delete photos", "move a to b"]
    moved = commands.command("move from to to to b", NOW)
    assert moved.to == commands.Destination("b") and moved.of.within == commands.Destination("to to")
    assert commands.destination(["new", "folder"]) == commands.Destination("new") and commands.destination(["a", "new", "folder", "x"]) == commands.Destination("x", True) and commands.destination(["folder"]) is None
    assert commands.command("delete photos from last week", NOW).of.within is None and commands.command("delete photos from june", NOW).of.within == commands.Destination("june")  # a month's name alone is text
    assert commands.command("tag it as gray", NOW).to == commands.Tag("Gray", "grey") and commands.command("tag it as gray", NOW).of.picked
    assert commands.question(["count", "my", "everything"], NOW).of == commands.Selection("everything") and commands.question(["largest"], NOW) is None
    assert commands.go("open x in new tab".split()) == commands.Go("x", True) and commands.go("go to the".split()) == commands.Go("the")
    assert ("zip selected", "Compress to ZIP") in commands.suggested("comp") and commands.suggested("zip xyz") == commands.suggested("zip") and len(commands.suggested("")) == 14


def test_sentences_over_a_catalog(spark):
    rows = [(1, 0, 1, "r", True, None, None), (2, 1, 1, "Docs", True, None, None), (3, 1, 1, "docs", True, None, None), (4, 1, 1, "Archive", True, None, None), (5, 2, 1, "deep", True, None, None),
            (6, 5, 1, "a.pdf", False, 10, 0), (7, 3, 1, "b.pdf", False, None, None), (8, 4, 1, "c.png", False, 7, 0)]
    paths = catalogs.with_paths(spark.createDataFrame(rows, "id long, parent long, root long, name string, is_dir boolean, size long, mtime long"))
    place = lambda name, create=False: sentences.resolved(commands.Destination(name, create), paths, "/r")
    assert place("docs") == "/r/docs" and place("Docs") == "/r/Docs" and place("DOCS") == "/r/Docs" and place("here") == "/r" and place("Docs/deep") == "/r/Docs/deep" and place("/r/Docs/deep/") == "/r/Docs/deep"
    assert place("archvie") == "/r/Archive" and place("nowhere") is None and place("new", True) == "/r/new" and place("/x") is None and place("a/b", True) is None
    ask = lambda t, **k: [tuple(r) for r in sentences.answered(commands.interpreted(t, NOW), paths, "/r", **k).collect()]
    assert ask("how many pdfs") == [(2,)] and ask("how big is Docs") == [(1, 10)] and ask("how big are pdfs") == [(2, 10)] and ask("how many pdfs in archive") == [(0,)] and ask("how big is archive") == [(1, 7)]
    assert ask("largest files") == [(6, "/r/Docs/deep/a.pdf", 10), (8, "/r/Archive/c.png", 7)] and ask("how many files tag:Work", tagged=spark.createDataFrame([("/r/docs/b.pdf", "work")], "path string, tag string")) == [(1,)]
    assert ask("how many selected", picked=spark.createDataFrame([("/r/docs/b.pdf",)], "path string")) == [(1,)]
    with pytest.raises(ValueError):
        ask("how many pdfs in nowhere")
    empty = paths.limit(0)
    assert sentences.answered(commands.interpreted("how big are pdfs", NOW), empty).collect()[0]["bytes"] == 0
