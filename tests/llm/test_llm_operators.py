"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from rivulet.llm import chat, decontaminate, order_minhash, packing, repeats, sharding, simhash, toxicity, url_filter, warc
from rivulet.llm.common import materialise, shared_path
from rivulet.llm.components import connected_components

RNG = random.Random(11)
WORDS = [f"w{i}" for i in range(900)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base, passage = prose(300), prose(70)
    rows = [(0, base), (1, base), (2, base + " end"), (3, None), (4, ""), (5, "one two"), (None, prose(80)), (7, prose(40) + " " + passage), (8, passage + "\n" + prose(33)), (9, prose(4000)), (9, prose(60)), (10, base), (10, base)]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp int, shard int")
    return materialise(df, "test-docs")


def test_url_filter(spark):
    urls = ["https://A.Example.org/es/x?q", "http://example.org/en/123#a", "notexample.org/es/", None, "", "x://com/fr/", "ftp://spam-farm.net/a", "http://fr.com", "http://b.com/de/\u00e9", "http://example.org/es"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("old"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, url_filter.RULES).collect()}
    assert got == {
        0: ("a.example.org", "/es/x", "example.org/es/", "block"), 1: ("example.org", "/en/123", "example.org/en/1", "block"), 2: ("", "", None, "allow"),
        3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("com", "/fr/", "com/fr/", "allow"), 6: ("spam-farm.net", "/a", None, "block"),
        7: ("fr.com", "", None, "allow"), 8: ("b.com", "/de/\u00e9", "com/de/", "block"), 9: ("example.org", "/es", "org/", "allow"),
    }
    assert url_filter.judge_urls(df.limit(0), url_filter.RULES).count() == 0
    assert url_filter.judge_urls(df, []).where("verdict = 'allow'").count() == len(urls)


def test_many_rules_as_brute_force(spark):
    rules = [url_filter.host_path_rule(RNG.choice(["allow", "block"]), f"{RNG.choice('abc')}{RNG.choice(['.x', '', '.y.z'])}/{RNG.choice(['', 'p/', 'p', 'q-r/1'])}") for _ in range(60)]
    rules = list({r.name: r for r in rules}.values())
    urls = [f"h://{RNG.choice(['', 'm.'])}{RNG.choice('abc')}{RNG.choice(['.x', '', '.y.z'])}{RNG.choice(['', '/', '/p/', '/pp', '/q-r/12', '/Q-r/1'])}" for _ in range(300)]
    got = url_filter.judge_urls(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()
    for r in got:
        fit = [x for x in rules if (r["host"] == x.name.split("/")[0] or r["host"].endswith("." + x.name.split("/")[0])) and r["path"].startswith("/" + x.name.split("/", 1)[1])]
        assert r["rule"] == (max(fit, key=lambda x: (len(x.name), x.action == "block", x.name)).name if fit else None)


def test_long_rule_lists_are_joined(spark, monkeypatch):
    """Both forms of the index give the same, rules without a literal token included."""
    rules = [url_filter.host_path_rule(a, r) for a, r in (("allow", "a.x/"), ("block", "a.x/p"), ("block", "b/"), ("allow", "-/"))] + [url_filter.wildcard_rule("block", "*bad*"), url_filter.wildcard_rule("allow", "c/*/q")]
    urls = [(u,) for u in ("h://a.x/pp", "h://m.a.x/", "h://-/1", "h://x.-/", "h://b", "h://b/", "h://zbadz/", "h://c/bad/q", "h://c/1/q", "h://c/1/qq", None, "none", "h://a.x/pp")]
    df = spark.createDataFrame(urls, "url string").withColumn("_best", F.lit(7))
    inline = sorted(map(repr, url_filter.judge_urls(df, rules).collect()))
    monkeypatch.setattr(url_filter, "INLINE_RULES", 0)
    joined = url_filter.judge_urls(df, rules)
    assert sorted(map(repr, joined.collect())) == inline and len(inline) == len(urls)
    assert not any(x in joined._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Arrow", "Cartesian", "NestedLoop"))
    many = [url_filter.host_path_rule("block", f"h{i}.net/") for i in range(1200)]
    monkeypatch.setattr(url_filter, "INLINE_RULES", 1000)
    got = url_filter.judge_urls(spark.range(3000).selectExpr("concat('u://w.h', id, '.net/p') AS url"), many)
    assert got.where("verdict = 'block'").count() == 1200


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 120)] + [(5, 5), (None, 3), (200, 201), (201, 202), (200, 202)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, **{x: 100 for x in range(101, 120)}, 201: 200, 202: 200}


@pytest.mark.parametrize("at_once", [1 << 20, 50])
def test_combined_edges_have_the_same_components(spark, monkeypatch, at_once):
    from rivulet.llm import components

    monkeypatch.setattr(components, "AT_ONCE", at_once)
    rng = random.Random(61)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, i) for i in range(1000, 1400)] + [(i, i + 1) for i in range(1000, 1399)] * 3
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    few = components.combined(df)
    assert few.count() < len(edges) and components.combined(df.limit(0)).count() == 0
    assert dict(map(tuple, connected_components(few).collect())) == dict(map(tuple, connected_components(df).collect()))


def test_near_duplicates_against_brute_force(spark, docs):
    got = simhash.near_duplicates(docs.drop("fp")).collect()
    assert len(got) == docs.count()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    fps = [simhash.simhash((t or "").encode()) for _, t in texts]
    want = []
    for i, f in enumerate(fps):
        group, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += [y for y in range(len(fps)) if (fps[x] ^ fps[y]).bit_count() <= 4]
        want.append((texts[i][0], f"{f:016x}", min((texts[x][0] for x in group if texts[x][0] is not None), default=None)))
    assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["fingerprint"], r["component_id"])) for r in got)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id IN (0, 1, 10)").count() == 1 and kept.where("doc_id IS NULL").count() == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_similar_documents_against_brute_force(spark):
    """Five-word shingle sets of 0.8 or more are linked, others never."""
    rng = random.Random(23)
    texts = ["", None, " ", "one two", "ONE  two", "one two three"]
    for n in (40, 120, 300) * 8:
        base = [rng.choice(WORDS) for _ in range(n)]
        texts.append(" ".join(base))
        for changes in (1, 2, 3, 5, 8):
            new = list(base)
            for at in rng.sample(range(n), max(1, changes * n // 120)):
                new[at] = rng.choice(WORDS)
            texts.append(" ".join(new))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    sets = [simhash.shingles((t or "").encode()) for t in texts]
    group = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if simhash.similarity_of(sets[a], sets[b]) >= 0.8 and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    got = dict(map(tuple, simhash.similar(df).collect()))
    apart = sum(got[i] != g for i, g in enumerate(group))
    assert all(group[got[i]] == g for i, g in enumerate(group)) and apart <= 1 and len(set(group)) < len(texts) - 40
    assert {r["doc_id"] for r in simhash.keep_one(df).collect()} == set(got.values())


def test_a_group_of_loose_near_copies_is_hardly_verified(spark, monkeypatch):
    """Members mostly less alike than 0.8: each still meets what it is linked with, at a few verified pairs a member."""
    rng = random.Random(29)
    base = [rng.choice(WORDS) for _ in range(140)]
    texts = []
    for i in range(400):
        new = list(base)
        for at in rng.sample(range(140), 2 + i % 4):
            new[at] = f"x{i}"
        texts.append(" ".join(new))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    verified, write = [], simhash.materialise

    def counted(frame, name):
        out = write(frame, name)
        if name == "pairs":
            verified.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    got = dict(map(tuple, simhash.similar(df).collect()))
    sets = [simhash.shingles(t.encode()) for t in texts]
    group = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if group[a] != group[b] and simhash.similarity_of(sets[a], sets[b]) >= 0.8:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    assert all(group[got[i]] == g for i, g in enumerate(group)) and sum(got[i] != g for i, g in enumerate(group)) <= 4
    assert sum(verified) < 10 * len(texts)  # 28,106 without the proof by parity


def test_packing(spark, docs):
    got = packing.pack(docs).collect()
    by_seq, by_doc = {}, {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert by_doc[3] == by_doc[4] == [(0, 0, 1)] and len(by_doc[10]) == 2 * len(by_doc[0])
    loose = [r["length"] for r in got if r["length"] < 1024]
    assert len(by_seq) <= len(got) - len(loose) + len(packing.best_fit(loose, 1024)) + 1
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_of_partitions_with_unlike_lengths(spark):
    """640 and 384 ids: one sequence for each pair, though no partition can fill one by itself."""
    n = 3_000
    df = spark.range(0, 2 * n, 1, 2).select(F.col("id").alias("doc_id"), F.expr(f"repeat(' the', if(id < {n}, 639, 383))").alias("text"))
    got = packing.pack(df)
    assert got.groupBy("length").count().sort("length").collect() == [(384, n), (640, n)]
    loads = got.groupBy("sequence_id").agg(F.sum("length").alias("total"), F.max("offset").alias("last"), F.min("offset").alias("first"))
    assert loads.count() == n and loads.where("total = 1024 AND first = 0 AND last IN (384, 640)").count() == n


def test_chat(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", None), (None, 0, "tool", "x"), (2, None, None, "y"), (3, 0, "user", "t"), (3, 0, "user", "t"), (3, 1, "assistant", "z" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat.format_chats(df)
    formatted = {r["conv_id"]: r["formatted"] for r in out.collect()}
    assert chat.parse(formatted[1]) == [("user", ""), ("assistant", "b</s>")] and chat.parse(formatted[None]) == [("tool", "x")]
    back = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    assert (back[3]["n_turns"], back[3]["loss_chars"], back[2]["loss_chars"]) == (3, 5000, 0)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_decontaminate(spark, docs):
    item = next(r["text"] for r in docs.where("doc_id = 7").collect()).split()[40:80]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, prose(30)), (5, " ".join(item).upper())], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["edits"]) for r in decontaminate.contaminations(docs, bench).collect())
    assert got == [(7, 1, 0), (7, 5, 0), (8, 1, 0), (8, 5, 0)]
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert decontaminate.contaminations(docs, bench.limit(0)).count() == 0 and decontaminate.contaminations(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("pass_bytes", [1 << 24, 150])
def test_cleaning_needs_no_id(spark, monkeypatch, pass_bytes):
    """A leak in a row without an id goes; a clean row stays though another of its id has a leak."""
    monkeypatch.setattr(decontaminate, "PASS_BYTES", pass_bytes)
    items = [prose(30), prose(30), prose(3)]
    texts = [(None, items[0]), (None, prose(50)), (1, prose(20) + " " + items[1]), (1, prose(60)), (2, prose(9) + " " + items[2] + " " + prose(9)), (3, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    kept = sorted(map(repr, map(tuple, decontaminate.clean(df, bench).collect())))
    assert kept == sorted(map(repr, [texts[1], texts[3], texts[5]]))


def test_toxicity(spark):
    rng = random.Random(12)
    rows = []
    for i in range(600):
        bad, junk = rng.random() < 0.2, rng.random() < 0.2
        words = [rng.choice(WORDS) for _ in range(40)] + [rng.choice(["vile", "rotten"])] * bad + ["@@@", "zzzz"] * junk
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(junk), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, low_quality int, toxic int")
    held, seen = df.where("doc_id >= 400"), df.where("doc_id < 400")
    chain = toxicity.train(seen.select("doc_id", "text"), seen.select("doc_id", "low_quality", "toxic"), toxicity.CATEGORIES)
    scored = toxicity.score(held, chain).join(held, "doc_id")
    right = scored.where((F.col("p_toxic") >= 0.5) == (F.col("toxic") == 1)).count() / scored.count()
    assert right > 0.97 and len(chain[1].earlier) == 1
    odd = spark.createDataFrame([(1, None, 0), (None, "vile", 0), (1, "", 0), (1, "", 0)], "doc_id long, text string, p_toxic int")
    assert toxicity.score(odd, chain).count() == 4 and toxicity.score(odd.limit(0), chain).count() == 0
    empty = toxicity.train(seen.limit(0).select("doc_id", "text"), seen.select("doc_id", "low_quality", "toxic"), toxicity.CATEGORIES)
    assert toxicity.score(odd, empty).where("p_toxic < 0.5").count() == 4
    assert toxicity.keep_civil(odd, odd, seen.limit(0).select("doc_id", "low_quality", "toxic")).count() == 4
    assert toxicity.keep_civil(df.drop("low_quality", "toxic"), seen.select("doc_id", "text"), seen.select("doc_id", "low_quality", "toxic")).columns == ["doc_id", "text"]


def test_sharding(spark, docs):
    df = spark.range(0, 1003, 1, 7).select(F.col("id"), (F.col("id") % 3).alias("slot"))
    for run_rows in (10**6, 5):
        got = sharding.shard(df, 10, run_rows=run_rows).collect()
        assert sorted(r["id"] for r in got) == list(range(1003))
        by = {}
        for r in got:
            by.setdefault(r["shard"], []).append(r["slot"])
        assert {len(s) for s in by.values()} == {100, 101} and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard(docs.drop("shard"), 40).count() == docs.count()
    assert sharding.shard(df.limit(0), 4).count() == 0


def brute_spans(texts):
    """Word spans that an earlier place has, by all 50-word stretches."""
    first, marks = {}, {}
    for key in sorted(texts):
        w = texts[key].split()
        for i in range(len(w) - repeats.LEAST + 1):
            s = tuple(w[i : i + repeats.LEAST])
            if s in first:
                marks.setdefault(key, set()).update(range(i, i + repeats.LEAST))
            else:
                first[s] = (key, i)
    return {k: sorted(v) for k, v in marks.items()}


def test_repeats_against_brute_force(spark):
    rng = random.Random(13)
    passages = [prose(n) for n in (50, 51, 64, 120, 49)]
    texts = {}
    for i in range(40):
        parts = [prose(rng.randrange(1, 60)) for _ in range(3)]
        parts[1:1] = rng.sample(passages, rng.randrange(3))
        texts[i] = "  ".join(parts)
    texts[40] = texts[3]
    texts[41] = "the " * 130
    texts[42] = passages[2] + " " + passages[2]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {}
    for r in repeats.repeated_spans(df).collect():
        got.setdefault(r["doc"], set()).update(range(r["start"], r["stop"]))
    assert {k: sorted(v) for k, v in got.items()} == brute_spans(texts)
    cut = {r["doc_id"]: r["text"] for r in repeats.cut_repeats(df).collect()}
    assert not brute_spans(cut) or all(len(v) for v in brute_spans(cut).values())
    assert cut[40] == "" and all(cut[k] == t for k, t in texts.items() if k not in got)


@pytest.mark.parametrize("often", [1, 3, 1024])
def test_repeats_of_texts_under_one_id(spark, monkeypatch, often):
    """Null ids with different texts, also where both text hashes are the same; repeated rows; frequent grams."""
    monkeypatch.setattr(repeats, "OFTEN", often)
    rng = random.Random(17)
    line, body = prose(60), prose(90)
    own = lambda i, n: " ".join(f"u{i}v{k}" for k in range(n))  # noqa: E731  words that no other text has
    texts = [(None, f"{own(i, rng.randrange(5, 40))} {line} {own(i, rng.randrange(40, 300))}") for i in range(25)] + [(7, body), (7, body), (8, body), (7, prose(30) + " " + line), (9, "a b " * 80)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {}
    for r in repeats.repeated_spans(df).collect():
        got.setdefault((r["no_id"], r["doc"], r["bytes"]), set()).update(range(r["start"], r["stop"]))
    first = min((t for t in texts if t[0] == 7 and line in t[1]), key=lambda t: t[0])
    for i, t in texts[:25]:
        at = t.split().index(line.split()[0])
        while t.split()[at : at + 60] != line.split():
            at += 1
        assert sorted(got[True, 0, len(t)]) == list(range(at, at + 60))
    assert (False, 7, len(first[1])) not in got and (False, 7, len(body)) not in got and sorted(got[False, 8, len(body)]) == list(range(90))
    assert sorted(got[False, 9, len("a b " * 80)]) == list(range(2, 160)) and len(got) == 27
    cut = repeats.cut_repeats(df)
    assert cut.count() == len(texts) and cut.where("doc_id = 7 AND text = ''").count() == 0 and cut.where("doc_id IS NULL").where(F.length("text") < 4).count() == 0


def test_repeats_where_all_text_hashes_are_equal(spark, monkeypatch):
    """Colliding text hashes: the length still tells a 53-word and a 401-word text apart."""
    monkeypatch.setattr(repeats, "keyed", lambda docs, id="doc_id", text="text": [c if n not in ("h1", "h2") else F.lit(1).cast("long").alias(n) for n, c in zip(repeats.KEY, KEYED(docs, id, text))])
    texts = [prose(53), prose(401)]
    df = spark.createDataFrame([(None, texts[0]), (None, texts[1] + " " + texts[0]), (None, texts[1])], "doc_id long, text string")
    out = {r["text"] for r in repeats.cut_repeats(df).collect()}
    assert sum(len(t.split()) for t in out) == 454


KEYED = repeats.keyed


def test_repeats_edge_cases(spark, docs):
    out = repeats.cut_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = {r["doc_id"]: r["text"] for r in out.collect()}
    assert rows[3] is None and rows[4] == "" and rows[1] == "" and rows[0] is not None and rows[8].strip() == " ".join(rows[8].split())
    assert repeats.repeated_spans(docs.limit(0)).count() == 0


def test_warc_of_ordered_pages_keeps_every_payload(spark):
    """A frame that is sorted anew each time it is read, with fully repeated rows."""
    n = 4_000
    pages = spark.range(0, 2 * n, 1, 5).selectExpr("id % 7900 AS page_id", "concat('http://h/', id % 7900) AS url", f"concat(repeat('pay', 40), id % {n} % 3900) AS html", "repeat('x', cast(id % 50 as int)) AS pad")
    pages = pages.orderBy(F.xxhash64("page_id"), "pad")
    got = warc.read_archives(warc.write_archives(pages, shared_path(spark, "test-warc"))).toPandas()
    assert len(got) == 2 * n and (got["record_type"] == "response").sum() == got["payload_digest"].nunique() == 3900
    least = got.groupby("payload_digest")["page_id"].transform("min")
    again = got["record_type"] == "revisit"
    assert (got["refers_to"][again] == least[again]).all() and (got["page_id"][~again] == least[~again]).all()


def test_warc(spark):
    rows = [(3, "http://a", "x" * 200), (1, None, "x" * 200), (2, "http://b\r\nX: y", "x" * 200), (4, "u", "s"), (5, "u", "s"), (6, "u", None), (7, "u", "é" * 100), (7, "u", "é" * 100), (None, "u", "x" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    got = warc.read_archives(warc.write_archives(df, shared_path(spark, "test-warc"))).collect()
    assert sorted(repr((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"])) for r in got) == sorted(map(repr, [
        (1, "response", None, 200), (2, "revisit", 1, 200), (3, "revisit", 1, 200), (4, "response", None, 1), (5, "response", None, 1), (6, "response", None, 0),
        (7, "response", None, 200), (7, "revisit", 7, 200), (None, "revisit", 1, 200)]))
    assert warc.read_archives(warc.write_archives(df.limit(0), shared_path(spark, "test-warc"))).count() == 0


def plain_order_minhash(text):
    """The fingerprint by its definition: for each permutation the two numbered 3-grams of least value, in text order, hashed as a tuple."""
    import xxhash

    mask, m = (1 << 64) - 1, order_minhash
    mix = lambda x: (y := ((x ^ x >> 32) * 0xD6E8FEB86659FD93) & mask) ^ y >> 32
    words = text.encode().split()
    if len(words) < 3:
        grams = [xxhash.xxh3_64_intdigest(b" ".join(words))]
    else:
        grams = []
        for i in range(len(words) - 2):
            h = xxhash.xxh3_64_intdigest(words[i])
            for w in words[i + 1 : i + 3]:
                h = mix((h * 0x9E3779B97F4A7C15 + xxhash.xxh3_64_intdigest(w)) & mask)
            grams.append(h)
    seen, keys = {}, []
    for g in grams:
        keys.append(mix((g + seen.get(g, 0) * 0xC2B2AE3D27D4EB4F) & mask))
        seen[g] = seen.get(g, 0) + 1
    out = []
    for times, flip in zip(m._TIMES.tolist(), m._FLIP.tolist()):
        least = sorted(sorted(range(len(keys)), key=lambda i: ((keys[i] ^ flip) * times) & mask)[:2])
        h = 0
        for i in least:
            h = mix((h * 0x9E3779B97F4A7C15 + grams[i] + 1) & mask)
        out.append(h >> 32)
    return out


def test_order_minhash_neighbours_by_brute_force(spark, docs):
    import hashlib

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    extra = spark.createDataFrame([(-(1 << 63), "least of all"), ((1 << 63) - 1, "most"), *[(None, f"null {i % 3} of many") for i in range(9)], *[(5, "again and again") for _ in range(20)]], "doc_id long, text string")
    more = docs.select("doc_id", "text").unionByName(extra.repartition(4))
    hexes = lambda fp: "".join(f"{x:08x}" for x in fp)
    near = lambda a, b: round(sum(x == y for x, y in zip(a, b)) / len(a), 6)
    for part in (docs, more, docs.where("doc_id = 0"), docs.where("doc_id IS NULL"), extra.where("doc_id = 5"), docs.limit(0)):
        got = order_minhash.neighbour_report(part).collect()
        rows = sorted(((r["doc_id"], r["text"] or "") for r in part.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
        want = []
        for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1]):
            third = len(t) // 3
            changed = t[: len(t) - third] + n[:third]
            own, other, after = map(plain_order_minhash, (t, changed, n))
            want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), hexes(own), hexes(other), near(own, other), near(own, after)))
        assert sorted(map(repr, want)) == sorted(repr((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 6), round(r["near_next"], 6))) for r in got)


def test_packing_query_against_the_tokenizers_library(spark):
    """Every piece's ids, checksum and start from the library that made the vocabulary; bins by the laws and against best fit on all pieces."""
    import struct
    import zlib

    from tokenizers import Tokenizer

    from rivulet.llm.tokens import default_vocabulary

    sf, t = "/root/testdata/sf0.001", Tokenizer.from_file(default_vocabulary())
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 if len(ids) > 1024 and len(ids) % 1024 else min(len(ids), 1024)
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        want += [(r["doc_id"], k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = packing.query(spark, sf).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= len(packing.best_fit([w[3] for w in want], 1024)) + 1


def test_toxicity_query_by_brute_force(spark):
    """Every probability again, word by word, from the fitted chain; a second fit gives the same one."""
    import math

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), toxicity._labels(spark, sf)
    chain = toxicity.train(docs, labels, toxicity.CATEGORIES)
    weights = [dict(zip(link.words.tolist(), link.weights.tolist())) for link in chain]
    want = {}
    for r in docs.collect():
        found, before = toxicity.features((r["text"] or "").encode()).tolist(), []
        for link, by_word in zip(chain, weights):
            z = link.bias + sum(by_word.get(w, 0.0) for w in found) + sum(a * b for a, b in zip(before, link.earlier.tolist()))
            before.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        want[r["doc_id"]] = before
    got = {r["doc_id"]: r for r in toxicity.query(spark, sf).collect()}
    assert set(got) == set(want)
    for i, (junk, bad) in want.items():
        assert abs(got[i]["p_low_quality"] - junk) < 1e-6 and abs(got[i]["p_toxic"] - bad) < 1e-6 and got[i]["rejected"] == (got[i]["p_toxic"] >= 0.5)


def test_training_takes_whole_texts_and_bounded_rows(spark):
    """Words beyond any prefix count, and an id that is repeated many times is one example."""
    rows = [(i, " ".join(f"x{i}y{k}" for k in range(3_000)) + (" vile" if i % 2 else " kind"), 0, i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, low_quality int, toxic int").repartition(3)
    docs = df.select("doc_id", "text")
    flood = docs.where("doc_id = 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("k")
    chain = toxicity.train(docs, df.drop("text"), toxicity.CATEGORIES)
    again = toxicity.train(docs.unionByName(flood), df.drop("text").unionByName(df.drop("text")), toxicity.CATEGORIES)
    for a, b in zip(chain, again):
        assert a.words.tolist() == b.words.tolist() and abs(a.weights - b.weights).max(initial=0) < 1e-9
    assert toxicity.score(docs, chain).join(df.select("doc_id", "toxic"), "doc_id").where("(p_toxic >= 0.5) <> (toxic = 1)").count() == 0
    few = toxicity.train(docs, df.drop("text"), toxicity.CATEGORIES, sample_bytes=1)
    assert not any(len(link.words) for link in few)


def test_sharding_query_holds_its_law(spark):
    import zlib

    sf = "/root/testdata/sf0.001"
    got = sharding.query(spark, sf).collect()
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i, len(t) + 16, zlib.crc32(t)) for i, t in docs.items())
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(40)) and {len(s) for s in slots.values()} <= {len(docs) // 40, len(docs) // 40 + 1}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def test_sharding_query_shuffles_whole_documents(spark, monkeypatch):
    """The digests are those of the texts that come out of the operator, which gets all columns."""
    import zlib

    sf, shard, given = "/root/testdata/sf0.001", sharding.shard, []

    def marked(df, shards):
        given.append(df.columns)
        return shard(df, shards).withColumn("text", F.concat(F.lit("\u00e9 "), F.coalesce("text", F.lit(""))))

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    monkeypatch.setattr(sharding, "shard", marked)
    got = sharding.query(spark, sf)
    want = [(r["doc_id"], t) for r in docs.collect() for t in [("\u00e9 " + (r["text"] or "")).encode()]]
    assert given == [docs.columns]
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got.collect()) == sorted((i, len(t) + 16, zlib.crc32(t)) for i, t in want)


def test_shuffles_are_uniform(spark):
    """Over many seeds every row comes to every shard and slot equally often, wherever it stood."""
    df = spark.range(0, 12, 1, 3)
    out = None
    for seed in range(12):
        part = sharding.shard(df, 3, seed=seed)
        out = part if out is None else out.unionByName(part)
    seen = out.groupBy("id", "shard").count().collect()
    assert out.count() == 144 and max(r["count"] for r in seen) <= 11
    import numpy as np

    before, sizes = np.array([0, 4, 8, 12]), sharding.shard_sizes(12, 3)
    share = np.mean([sharding.matrix_row(before, sizes, p, s) for s in range(1500) for p in (0, 1, 2)], axis=0)
    assert abs(share - 4 / 3).max() < 0.06


def test_inner_names_may_be_columns(spark, docs):
    """Columns named like those that the operators add for themselves come through unchanged."""
    inner = ("_row", "_doc", "_tag", "_spans", "_part", "_run", "_key", "_ahead", "_text", "_gone", "component_id", "places")
    df = docs.drop("fp", "shard")
    wide = materialise(df.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in inner]), "test-wide")
    bench = spark.createDataFrame([(1, prose(40))], "item_id long, text string")
    labels = spark.createDataFrame([(0, 0, 1), (7, 0, 0), (8, 0, 0)], "doc_id long, low_quality int, toxic int")
    for out in (simhash.keep_one(wide), repeats.cut_repeats(wide), decontaminate.clean(wide, bench), toxicity.keep_civil(wide, wide, labels), sharding.shard(wide, 3, run_rows=2)):
        rows = out.collect()
        assert rows and [c for c in out.columns if c not in ("shard", "slot")] == wide.columns
        assert all(r[c] == (None if r["doc_id"] is None else f"{c}{r['doc_id']}") for r in rows for c in inner)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert set(out.columns) >= {"doc_id", "piece", "sequence_id", "offset"} and 0 < out.select("doc_id").distinct().count() < docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns
