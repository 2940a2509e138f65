"""Jaccard join, decontamination and line dedup against brute force, and on odd inputs."""

from __future__ import annotations

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom.llm import components, decontaminate, jaccard_join, line_dedup, queries, simhash

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(40)]


def brute_components(pairs, ids):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    ids = {i for p in pairs for i in p if p[0] != p[1]}
    assert got == brute_components([p for p in pairs if p[0] != p[1]], ids)


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def near_texts(rng, n):
    """Texts in families: copies with a few changed words, of short and long sizes."""
    out = []
    while len(out) < n:
        base = [rng.choice(WORDS) for _ in range(rng.choice([1, 3, 5, 9, 12, 30, 80, 200]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [rng.choice(WORDS)], [copy[at], "x"]])
                copy = copy or ["z"]
            out.append(" ".join(copy))
    return out[:n]


@pytest.mark.parametrize(("width", "least"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard_by_brute_force(spark, width, least):
    rng = random.Random(width)
    texts = [*near_texts(rng, 160), None, "", "  \n", "A b C", "a B c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t, width) for t in texts]
    pairs = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])
    ]
    want = brute_components(pairs, range(len(texts)))
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_components(docs, width, least).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}


def test_jaccard_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.sql(queries.oracle_sql()["op3_jaccard_join"]).fetchall())
    got = sorted(tuple(r) for r in queries.op3_jaccard_join(spark, SF).select("doc_id", "n_shingles", "component_id", "class_id").collect())
    assert got == want


def test_boundary_follows_the_cost():
    assert jaccard_join.boundary(1.0, 85) <= jaccard_join.boundary(10.0, 85) <= jaccard_join.boundary(1e6, 85) == jaccard_join.LIGHT_MOST
    for n in range(1, 300):
        assert jaccard_join.prefix_size(n, 1, 85) == n - -(-85 * n // 100) + 1


def test_keep_one(spark):
    base = " ".join(WORDS)
    rows = [(1, base, "en"), (2, base, "en"), (3, base + " x", "en"), (4, "other text of its own here", "en"), (5, None, "en"), (6, "", None), (None, base, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = jaccard_join.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(got, key=str) == sorted([4, 5, 6, *[i for i in got if i in (1, None)]], key=str) and len(got) == 4
    assert jaccard_join.keep_one(docs.where("false"), 5, 80).count() == 0


def test_fingerprints_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(g, rng.getrandbits(64) - 2**63) for g in range(20) for _ in range(rng.randint(1, 30))]
    summed = spark.createDataFrame(rows, "g int, h long").groupBy("g").agg(*simhash.lane_sums(F.col("h")), F.count("*").alias("n"))
    narrow = spark.createDataFrame(rows, "g int, h long").withColumn("part", F.col("h") % 2).groupBy("g", "part").agg(*simhash.lane_sums(F.col("h"), simhash.NARROW), F.count("*").alias("n"))
    added = narrow.groupBy("g").agg(*simhash.bit_counts(simhash.NARROW), F.sum("n").alias("n")).select("g", simhash.fingerprint_of_counts(F.col("n")).alias("f"))
    by_parts = {r["g"]: r["f"] for r in added.collect()}
    for r in summed.select("g", simhash.fingerprint(F.col("n")).alias("f")).collect():
        hs = [h for g, h in rows if g == r["g"]]
        assert r["f"] == by_parts[r["g"]] == sum(1 << b for b in range(simhash.BITS) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@pytest.mark.parametrize(("radius", "agree"), [(3, 1), (3, 2), (15, 1), (2, 3)])
def test_blocks_find_all_within_the_radius(spark, radius, agree):
    rng = random.Random(radius)
    rows = []
    for i in range(200):
        f = rng.getrandbits(simhash.BITS)
        for b in rng.sample(range(simhash.BITS), radius):
            f2 = f ^ (1 << b)
            rows.append((i, f, f2))
            f = f2
    pairs = [(i, rows[i * radius][1], rows[i * radius + radius - 1][2]) for i in range(200)]
    keyed = spark.createDataFrame(pairs, "i int, a long, b long").select(
        "i", simhash.block_keys(F.col("a"), radius + agree, agree).alias("x"), simhash.block_keys(F.col("b"), radius + agree, agree).alias("y")
    )
    assert keyed.where("NOT arrays_overlap(x, y)").count() == 0


def test_plans_agree_more_for_more_rows():
    assert simhash.plan(1000, 3)[1] <= simhash.plan(10**9, 3)[1] <= simhash.plan(10**12, 3)[1]


def items_and_documents():
    rng = random.Random(7)
    items = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(300)}" for _ in range(rng.randint(14, 50))) for _ in range(30)]
    docs, planted = [], set()
    for i in range(120):
        filler = lambda: [f"z{rng.randrange(3000)}" for _ in range(rng.randint(0, 80))]
        text = filler()
        if i % 3 == 0:
            item = rng.randrange(30)
            text += items[item].upper().replace(" ", ", ").split(" ")
            planted.add((i, item))
        docs.append((i, " ".join(text + filler())))
    return items, docs, planted


def test_leaks_by_construction(spark):
    items, docs, planted = items_and_documents()
    words = items[0].split()
    docs += [(500, "x " + " ".join([*words[:-1], "other"]) + " y"), (501, " ".join(words[: len(words) // 2])), (502, None), (503, ""), (None, items[1]), (504, "q " * 60_000 + items[2])]
    planted |= {(500, 0), (None, 1), (504, 2)}
    docs += [(505, "here are a few words, in order"), (506, "few here words"), (507, "Only")]
    planted |= {(505, 90), (507, 93)}
    # One item is too long to count in one part, and stands nowhere whole.
    benchmark = [*enumerate(items), (3, items[3]), (90, "a few words"), (91, None), (92, ""), (93, "only"), (94, "v w x y z " * 230_000)]
    made = decontaminate.leaks(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, row string"), spark.createDataFrame(benchmark, "item_id long, text string"))
    got = made.collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == planted and len(got) == len(planted)
    assert all(r["similarity"] == 1.0 and r["distance"] == 0 for r in got if r["doc_id"] != 500)


def all_leaks(docs, items, least):
    """Every window of every item's length against the item, by its definition."""
    shingled = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in items.items()}
    weight = {}
    for shingles_ in shingled.values():
        for x in shingles_:
            weight[x] = weight.get(x, 0) + 1
    found = {}
    for d, words in docs.items():
        for k, w in items.items():
            for at in range(max(1, len(words) - len(w) + 1)):
                part = words[at : at + len(w)]
                own = {tuple(part[i : i + 5]) for i in range(len(part) - 4)}
                both = sum(1 / weight[x] for x in own & shingled[k])
                score = 2 * both / (sum(1 / weight[x] for x in shingled[k]) + both + len(own - shingled[k]))
                if score >= least - 1e-9:
                    found[d, k] = max(score, found.get((d, k), 0))
    return found


def test_recall_against_all_windows(spark):
    """Passages with changed words down to a similarity of 0.8, and items that share shingles."""
    rng = random.Random(11)
    pool = [f"{rng.choice('abcdefgh')}{i}" for i in range(400)]
    items = {k: [rng.choice(pool) for _ in range(rng.choice([8, 14, 24, 34, 54, 104]))] for k in range(40)}
    for k in range(30, 40):
        items[k][:8] = items[30][:8]
    docs = {}
    for d in range(500):
        words = list(items[d % 40])
        for _ in range(rng.randint(0, max(1, len(words) // 16))):
            at = rng.choice([0, len(words) - 1, rng.randrange(len(words))])
            words[at : at + 1] = rng.choice([[rng.choice(pool)], [rng.choice(pool)], [], [words[at], rng.choice(pool)]])
        docs[d] = [rng.choice(pool) for _ in range(rng.randint(0, 30))] + words + [rng.choice(pool) for _ in range(rng.randint(0, 30))]
    want = all_leaks(docs, items, 0.8)
    made = decontaminate.leaks(
        spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string"),
        spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string"),
    )
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in made.collect()}
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want) and len(want) > 300
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    edge = {k for k, x in want.items() if x < 0.86}
    assert len(edge) > 20 and len(edge & set(got)) >= 0.97 * len(edge)


def test_without_leaks_and_empty_tables(spark):
    items, docs, planted = items_and_documents()
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, leaked string")
    kept = decontaminate.without_leaks(table, benchmark)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in planted}
    assert decontaminate.without_leaks(table, benchmark.where("false")).count() == len(docs)
    assert decontaminate.leak_table(table.where("false"), benchmark).count() == 0


LINES = ["The quick brown fox jumps over the lazy dog near the old river bank today", "Second line of quite different words about boats", "short"]


def test_lines_kept_once(spark):
    near = LINES[0].upper().replace(" ", "  ") + "!!"
    rows = [
        (1, "\n".join(LINES), 9), (2, f"{near}\nnew words stand here alone\nshort", 9), (3, "--\n\n--", 9), (4, None, None), (5, "", 0),
        (6, "short\nshort\nShort.", 9), (None, "a null id line", 9), (7, "a null id line\nanother", 9),
    ]
    docs = spark.createDataFrame([(*r, "r", 1) for r in rows], "doc_id long, text string, n_chars long, row string, n_dropped int")
    made = line_dedup.dedup_lines(docs)
    assert made.columns[:5] == docs.columns
    got = {r["doc_id"]: r for r in made.collect()}
    assert got[1]["text"] == "\n".join(LINES)
    assert got[2]["text"] == "new words stand here alone" and got[2]["n_chars"] == 26
    assert (got[3]["text"], got[4]["text"], got[5]["text"], got[6]["text"]) == ("--\n\n--", None, "", "")
    assert got[None]["text"] == "a null id line" and got[7]["text"] == "another"
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def test_repeated_rows_are_treated_alike(spark):
    docs = spark.createDataFrame([(1, "one line here"), (1, "one line here"), (2, "one line here")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in line_dedup.line_table(docs).collect()) == [(1, "one line here"), (1, "one line here"), (2, "")]


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_groups_by_brute_force(spark):
    """All pairs of fingerprints within the radius, verified by an edit distance over words."""
    rng = random.Random(8)
    lines = [" ".join(f"{k}{x}" for k in range(300)) for x in ("", "", "a")]
    for _ in range(40):
        base = [rng.choice(WORDS) + rng.choice("abc") for _ in range(rng.randint(4, 60))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            lines.append(" ".join(copy))
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    places, comp = line_dedup.line_groups(docs)
    named = places.join(comp, "node", "left").select("doc_id", F.coalesce("comp", "node").alias("c")).collect()
    hashed = docs.select("doc_id", F.explode(F.split("text", " ")).alias("w")).select("doc_id", F.xxhash64("w").alias("h")).collect()
    bits = {}
    for r in hashed:
        bits.setdefault(r["doc_id"], []).append(r["h"])
    prints = {i: sum(1 << b for b in range(63) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) for i, hs in bits.items()}
    split = [x.split() for x in lines]
    pairs = []
    for i in range(len(lines)):
        for j in range(i):
            longer = max(len(split[i]), len(split[j]))
            if lines[i] == lines[j] or (prints[i] ^ prints[j]).bit_count() <= 3 and edit(split[i], split[j]) <= 0.2 * longer:
                pairs.append((i, j))
    want = brute_components(pairs, range(len(lines)))
    assert len({(r["c"], want[r["doc_id"]]) for r in named}) == len({r["c"] for r in named}) == len(set(want.values()))
    assert len(pairs) > 20


def test_lines_by_edit_similarity_alone(spark):
    """Near copies of all lengths, up to the most edits that the similarity allows."""
    rng = random.Random(9)
    lines = []
    for n in [4, 5, 5, 6, 7, 9, 10, 11, 14, 15, 19, 20, 24, 25, 34, 40, 60] * 3:
        base = [rng.choice(WORDS) + rng.choice("abc") for _ in range(n)]
        lines.append(" ".join(base))
        for _ in range(3):
            copy = list(base)
            for _ in range(rng.randint(1, max(1, n // 5 + 1))):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], [rng.choice(WORDS)], [copy[at], rng.choice(WORDS)]])
            lines.append(" ".join(copy))
    lines += ["a a a a a a a a a a", "a a a a b a a a a a", "a b a b a b a b a b a b", "b a b a b a b a b a b a"]
    split = [x.split() for x in lines]
    pairs = [(i, j) for i in range(len(lines)) for j in range(i) if 5 * edit(split[i], split[j]) <= max(len(split[i]), len(split[j]))]
    want = brute_components(pairs, range(len(lines)))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_table(docs).collect()}
    assert got == {i: int(c != i) for i, c in want.items()}
    assert len(pairs) > 60


@pytest.mark.parametrize("least", [80, 85, 95])
def test_jaccard_at_the_least_overlap(spark, least):
    """Pairs of sets of 20k - 1 and 20k words, and of other sizes, that share just enough, their own words rare ones."""
    texts, links = [], []
    for large in [*range(80, 281, 20), 90, 103]:
        for small in (large - 1, large):
            common = -(-least * (small + large) // (100 + least))
            for n in (small, large):
                texts.append(" ".join([f"c{len(links)}x{i}" for i in range(common)] + [f"o{len(texts)}x{i}" for i in range(n - common)]))
            links.append((len(texts) - 1, len(texts) - 2))
    sets = [set(t.split()) for t in texts]
    assert all(100 * len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) for a, b in links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(docs, 1, least).collect()}
    assert got == brute_components(links, range(len(texts)))


def test_words_with_one_character_stay_apart(spark):
    point = F.pmod(F.hash("w"), F.lit(line_dedup._CHARACTERS))
    words = spark.range(6000).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("w"))
    one, two = sorted(words.groupBy(point.alias("p")).agg(F.collect_list("w").alias("ws")).where("size(ws) > 1").first()["ws"])[:2]
    rows = [
        # Two edits of five words, one if the first words counted as equal.
        (1, f"{one} alder birch cedar dogwood"), (2, f"{two} alder birch cedar elder"),
        # One edit, in lines that hold both words.
        (3, f"{one} {two} fir gum hazel iris juniper kapok larch maple"), (4, f"{one} {two} fir gum hazel iris juniper kapok larch nutmeg"),
    ]
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1}


def test_lines_that_share_a_passage_are_not_all_verified(spark, monkeypatch):
    """Long lines that share a passage but are not near copies stay out of the edit distance, and each pair is made once."""
    from graphloom.llm import components

    passage = " ".join(f"p{i}" for i in range(58))
    texts = [passage + " " + " ".join(f"w{d}x{i}" for i in range(30)) for d in range(40)]
    texts += [" ".join(f"c{i}" for i in range(100)), " ".join(f"c{i}" if i % 5 else f"e{i}" for i in range(100))]
    made, before = {}, components.stage

    def counted(df, name):
        out = before(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(components, "stage", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r.n_dropped for r in line_dedup.line_table(docs).collect()}
    assert [d for d, n in rows.items() if n] == [41]
    assert made["rest-pairs"] <= 40 * 39 / 2 / 10


def test_sequences_by_numpy_are_those_of_each_line():
    """All sequences of the asked lengths, none over a line's end, each in one share; equal ones have equal hashes."""
    import pyarrow as pa

    words = [[1, 2, 3, 1, 2, 3], [-7], [], [2, 3, 1], [1, 2]]
    lengths = [[3], [1], [], [2, 3], [1, 2]]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(5), pa.int64()), pa.array(words, pa.list_(pa.int32())), pa.array(lengths, pa.list_(pa.int32()))], ["id", "words", "lengths"]
    )
    found = [r for k in range(line_dedup.PASSES) for b in line_dedup._sequences(k)(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    wanted = [(i, tuple(w[p : p + q])) for i, (w, qs) in enumerate(zip(words, lengths, strict=True)) for q in qs for p in range(len(w) - q + 1)]
    assert sorted(i for i, _ in found) == sorted(i for i, _ in wanted)
    assert len({h for _, h in found}) == len({s for _, s in wanted})
    assert sum(i == 3 and h in {x for j, x in found if j == 0} for i, h in found) == 1
