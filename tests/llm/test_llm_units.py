"""The operators' own rules, without Spark."""

import io
import json
import random
import zipfile

import numpy as np
import pytest

from rivulet.llm import chat, decontaminate, order_minhash, packing, repeats, sharding, simhash, tokens, warc


def test_simhash_against_plain_python():
    import xxhash

    def plain(text):
        words = text.encode().lower().split()
        grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 50, 400):
        text = " ".join(rng.choice(["a", "B", "é", "cc", "d\u00a0d"]) for _ in range(n))
        assert simhash.simhash(text.encode()) == plain(text)


@pytest.mark.parametrize("most", [10**9, 4_000, 500])
def test_cell_links_join_all_within_the_radius(most):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 6, np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(12):
            x = b
            for bit in rng.integers(0, 64, rng.integers(1, 6)).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    a, b = simhash.cell_links(fps, fps, np.full(len(fps), 2, np.int8), 0, 4, most)
    assert (np.bitwise_count(a ^ b) >= 1).all()
    got = {int(f): int(f) for f in fps} | {int(x): int(y) for x, y in zip(a, b)}
    want = {}
    for f in fps.tolist():  # brute force
        group, todo = set(), [f]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += [y for y in fps.tolist() if bin(x ^ y).count("1") <= 4]
        want[f] = min(group)
    assert got == want


def test_ids_are_those_of_the_tokenizers_library():
    from tokenizers import Tokenizer

    path = tokens.default_vocabulary()
    t = Tokenizer.from_file(path)
    for text in ("", "Hello  world\n\n x", "été ça 12345 don't", "a<|endoftext|>b", "\U0001f600 \u200b\u00a0z", "x" * 3000, "\r\n\t tab"):
        assert tokens.token_ids(text, path).tolist() == t.encode(text, add_special_tokens=False).ids


def test_best_fit_and_cut():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 1025) for _ in range(3000)]
    bins = packing.best_fit(sizes, 1024)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    loads = [sum(sizes[i] for i in b) for b in bins]
    assert max(loads) <= 1024 and len(bins) <= 1.02 * sum(sizes) / 1024 + 1
    assert packing.cut(1024, 1024) == [(0, 1024)] and packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]


def test_matching_numbers_of_sizes_is_best_fit():
    rng = random.Random(21)
    for capacity in (5, 10, 64, 1024) * 10:
        counts = {s: rng.randrange(1, 40) for s in rng.sample(range(1, capacity), rng.randrange(min(capacity, 200)))}
        places, by_size = {}, {}
        for size, *run in packing.match(counts, capacity):
            by_size.setdefault(size, []).append(run)
        for size, found in by_size.items():
            for (rank, each, b, at), (end, *_) in zip(found, [*found[1:], [counts[size]]]):
                for k in range(end - rank):
                    places.setdefault(b + k // each, []).append((at + k % each * size, size))
        assert all(at == sum(s for _, s in sorted(p)[:i]) for p in places.values() for i, (at, _) in enumerate(sorted(p)))
        sizes = [s for s, n in counts.items() for _ in range(n)]
        loads = [sum(sizes[i] for i in b) for b in packing.best_fit(sizes, capacity)]
        assert sorted(sum(s for _, s in p) for p in places.values()) == sorted(loads)


def test_escapes_are_reversible_and_leave_no_control_string():
    rng = random.Random(3)
    parts = [*chat.CONTROL, "\\", "\\a", "\\b", "<", "[", "x", "</", "s>"]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randrange(9)))
        e = chat.escape(text)
        assert chat.unescape(e) == text and not any(c in e for c in chat.CONTROL)
    turns = [("user", "a[INST]"), ("tool[ROLE]", "</s>"), ("assistant", ""), ("system", "\\"), ("", "x")]
    assert chat.parse(chat.render(turns)) == turns


def test_locating_turns():
    turns = [("system", "s"), *[(r, f"{r} {i} </s>") for i in range(80) for r in ("user", "assistant")]]
    assert chat.locate(turns, chat.AppendOnly(lambda t: chat.render([t]))) == chat.locate(turns)
    odd = lambda ts: ("!" if 2 < len(ts) < 9 else "") + chat.render(ts)  # noqa: E731  as if nothing had been, from nine turns on
    assert all(chat.locate(turns[:n], odd)[1:] == ([], [], 2) for n in (12, 64, 66, 161))
    for part in (turns[:7], turns):
        whole, spans, loss, rewritten = chat.locate(part)
        assert rewritten is None and "".join(whole[a:b] for a, b in spans) == whole
        assert [chat.unescape(whole[a:b]) for a, b in loss] == [t for r, t in part if r == "assistant"]
    counting = lambda ts: "".join(f"#{i}{r}:{t};" for i, (r, t) in enumerate(ts))
    whole, spans, loss, rewritten = chat.locate(turns, counting)
    assert rewritten is None and [whole[a:b] for a, b in loss] == [t for r, t in turns if r == "assistant"]
    last_only = lambda ts: "".join(f"{r}:{t if i == len(ts) - 1 else '-'};" for i, (r, t) in enumerate(ts))
    assert chat.locate(turns[:5], last_only)[1:] == ([], [], 1)
    assert chat.locate([], chat.render) == ("", [], [], None)


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != v)))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(200):
        a, b = [[rng.randrange(4) for _ in range(rng.randrange(lo, 70))] for lo in (1, 0)]
        assert decontaminate.edit_distance_within(a, b)[0] == brute_distance(a, b)


def test_edited_items_are_found_and_others_not():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(n) for n in (5, 15, 15, 30, 45, 60)]
    plan = decontaminate.plan_for([(i, [w.encode() for w in x]) for i, x in enumerate(items)], 0.2, 0.99)
    found = tried = 0
    for _ in range(150):
        k = rng.randrange(1, len(items))
        new = list(items[k])
        for _ in range(rng.randrange(plan.edits(len(new)) + 1)):
            kind, p = rng.randrange(3), rng.randrange(len(new))
            new[p : p + (kind != 1)] = [rng.choice(vocabulary)] if kind != 2 else []
        doc = text(rng.randrange(80)) + new + text(rng.randrange(80))
        got = {r[1]: r for r in decontaminate.matches([" ".join(doc).encode()], plan)}
        within = {i for i, x in enumerate(items) if brute_distance(x, doc) <= plan.edits(len(x))}
        assert set(got) <= within
        for i, r in got.items():
            assert brute_distance(items[i], doc) == r[2] == brute_distance(items[i], doc[r[3] : r[4]])
        found, tried = found + (k in got), tried + 1
    assert found >= 0.97 * tried
    assert not list(decontaminate.matches([b"", b"  "], plan)) and not list(decontaminate.matches([b"a b"], decontaminate.plan_for([], 0.2, 0.99)))


@pytest.mark.parametrize("lengths", [[3] * 100 + [300] * 20, [3] * 400 + list(range(15, 60))])
def test_recall_at_all_edits_on_a_mixed_benchmark(lengths):
    rng = random.Random(22)
    vocabulary = [f"w{i}" for i in range(2000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(n) for n in lengths]
    plan = decontaminate.plan_for([(i, [w.encode() for w in x]) for i, x in enumerate(items)], 0.2, 0.99)
    found = 0
    for _ in range(100):
        k = rng.choice([k for k, n in enumerate(lengths) if n >= 5])
        new = list(items[k])
        for _ in range(plan.edits(len(new))):
            kind, p = rng.randrange(3), rng.randrange(len(new))
            new[p : p + (kind != 1)] = [rng.choice(vocabulary)] if kind != 2 else []
        doc = text(30) + new + items[0] + text(30)
        got = {r[1] for r in decontaminate.matches([" ".join(doc).encode()], plan)}
        assert 0 in got
        found += k in got
    assert found >= 97


def test_every_stretch_has_one_position_that_its_words_decide():
    rng = np.random.default_rng(6)
    words = rng.integers(0, 1 << 62, 400, np.uint64)
    again = np.concatenate([rng.integers(0, 1 << 62, 33, np.uint64), words[100:150], rng.integers(0, 1 << 62, 33, np.uint64)])
    flat, ends = np.concatenate([words, again, words[:30], words[7:8].repeat(120)]), np.cumsum([400, len(again), 30, 120])
    at, grams, low, high = repeats.minimisers(flat, ends)
    stands = {}
    for p, g, a, b in zip(at.tolist(), grams.tolist(), low.tolist(), high.tolist()):
        assert 0 <= a <= b < repeats.W
        for back in range(a, b + 1):
            assert p - back not in stands
            stands[p - back] = (back, g)
    begins = np.concatenate([[0], ends])
    assert set(stands) == {s for x, y in zip(begins, begins[1:]) for s in range(x, y - repeats.LEAST + 1)}
    assert stands[100] == stands[400 + 33]
    grams_of = repeats.gram_hashes(flat)
    assert all(g == min(grams_of[s : s + repeats.W].tolist()) for s, (_, g) in stands.items())


def test_copied_compares_words_on_both_sides():
    """Suffixes of one gram (also by an accident of hashes) against all stretches by brute force."""
    rng = random.Random(31)
    for _ in range(30):
        texts = [[rng.choice("ab") + str(rng.randrange(1 + (i % 7 == 0) * 3)) for i in range(110)] for _ in range(12)]
        rows = []
        for k, t in enumerate(texts):
            for at in rng.sample(range(30, 60), 3):
                low = rng.randrange(31)
                rows.append((rng.randrange(2), "\n".join(t[at : at + 50 - low]) + "\n", k, at, low, rng.randrange(low, 31), t))
        rows.sort(key=lambda r: r[:2])
        known = {}
        right = repeats._numbers([r[1].encode() for r in rows], repeats.LEAST, known)
        left = repeats._numbers(["".join(w + "\n" for w in reversed(r[6][r[3] - r[5] : r[3]])).encode() for r in rows], repeats.W - 1, known)
        low, high, rank = np.array([r[4] for r in rows]), np.array([r[5] for r in rows]), np.array(rng.sample(range(len(rows)), len(rows)))
        got = repeats.copied(np.array([r[0] for r in rows]), right, left, low, high, rank)
        first = {}
        for i in np.argsort(rank).tolist():
            g, _, _, at, a, b, t = rows[i]
            for back in range(repeats.W):
                stretch = (g, back, tuple(t[at - back : at - back + 50]))
                assert got[i, back] == (a <= back <= b and stretch in first), (i, back)
                if a <= back <= b:
                    first.setdefault(stretch, i)


def test_cut_words():
    assert repeats.cut_words(" a  b c\nd é f ", [(1, 3)]) == " a\nd é f "
    assert repeats.cut_words("a b c", [(0, 3)]) == "" and repeats.cut_words("a b c", [(0, 1), (2, 3)]) == " b"


def test_matrix_rows_have_exact_margins():
    counts, sizes = [5, 0, 7, 1, 20], sharding.shard_sizes(33, 4)
    before = np.concatenate([[0], np.cumsum(counts)])
    m = np.array([sharding.matrix_row(before, sizes, i, 3) for i in range(5)])
    assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == sizes.tolist() and (m >= 0).all()
    seen = np.array([sharding.matrix_row(np.array([0, 10, 20]), np.array([10, 10]), 0, s)[0] for s in range(2000)])
    assert abs(seen.mean() - 5) < 0.15 and abs(seen.var() - 10 * 0.25 * 10 / 19) < 0.15


def test_zip_and_zip64(tmp_path, monkeypatch):
    def build(path, records):
        path.write_bytes(warc.package(records))
        return str(path)

    heads = [{"WARC-Type": "response", "WARC-Record-ID": f"r{i}", "WARC-Date": warc.DATE, "WARC-Target-URI": f"http://b.a/{i}"} for i in range(5)]
    recs = [(h, warc.record(h, b"\r\n\r\n" * i)) for i, h in enumerate(heads)]
    plain = build(tmp_path / "a.zip", recs)
    assert [p for _, p in warc.read_archive(plain)] == [b"\r\n\r\n" * i for i in range(5)]
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    big = build(tmp_path / "b.zip", recs)
    assert b"PK\x06\x06" in (tmp_path / "b.zip").read_bytes()
    assert [h["warc-record-id"] for h, _ in warc.read_archive(big)] == [f"r{i}" for i in range(5)]
    for bad in (b"", b"PK", b"x" * 100):
        (tmp_path / "c.zip").write_bytes(bad)
        with pytest.raises(ValueError):
            warc.directory(warc.RangeFile(str(tmp_path / "c.zip")))
    with zipfile.ZipFile(tmp_path / "d.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/x.warc", "y" * 100)
    with pytest.raises(ValueError):
        list(warc.read_archive(str(tmp_path / "d.zip")))


@pytest.mark.parametrize("packed", [True, False])
def test_packages_of_other_writers(tmp_path, packed, monkeypatch):
    """Built by hand: other names, two archives, an index for one of them, HTTP headers, odd header lines, a compressed page list."""
    import gzip

    monkeypatch.setattr(warc, "RANGE", 64)
    one = lambda i, body: f"WARC/1.0\r\nwarc-type:response\r\nWARC-Record-ID:  <urn:x:{i}>\r\nX-Folded: a\r\n b\r\nno colon here\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    bodies = [b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\n" + b"<p>%d\r\n\r\n</p>" % i for i in range(6)]
    squeeze = gzip.compress if packed else bytes
    parts = [squeeze(one(i, b)) for i, b in enumerate(bodies)]
    ends = [sum(map(len, parts[:i])) for i in range(4)]
    name = "rec-1.warc.gz" if packed else "rec-1.warc"
    lines = [f'com,a)/{i} 2024010203040{i} {{"url": "http://a.com/{i}", "filename": "{name}", "offset": "{ends[i]}", "length": {len(parts[i])}, "mime": "text/html"}}' for i in (2, 0, 1)]
    with zipfile.ZipFile(tmp_path / "w.wacz", "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/", "")
        z.writestr(f"archive/{name}", b"".join(parts[:3]))
        z.writestr(f"archive/{name.replace('1', '2')}", b"".join(parts[3:]))
        z.writestr("indexes/index.cdx.gz", gzip.compress(("!meta 0 {}\n".replace("{}", "none") + "\n".join(lines)).encode()))
        z.writestr("pages/pages.jsonl", "{}" * 100, zipfile.ZIP_DEFLATED)
    got = list(warc.read_archive(str(tmp_path / "w.wacz")))
    assert [h["WARC-Record-ID"] for h, _ in got] == [f"<urn:x:{i}>" for i in (2, 0, 1, 3, 4, 5)]
    assert [p for _, p in got] == [b"<p>%d\r\n\r\n</p>" % i for i in (2, 0, 1, 3, 4, 5)] and got[0][0]["x-folded"] == "a b"


def test_long_items_need_little_memory():
    import resource

    rng = random.Random(41)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(20_000), *[text(rng.randrange(15, 60)) for _ in range(20)]]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    plan = decontaminate.plan_for([(i, [w.encode() for w in x]) for i, x in enumerate(items)], 0.2, 0.99)
    new = list(items[0])
    for _ in range(2_000):
        kind, p = rng.randrange(3), rng.randrange(len(new))
        new[p : p + (kind != 1)] = [rng.choice(vocabulary)] if kind != 2 else []
    got = list(decontaminate.matches([" ".join(text(300) + new + items[4]).encode(), " ".join(text(9000)).encode()], plan))
    assert [(t, k) for t, k, *_ in got] == [(0, 0), (0, 4)] and got[0][2] <= 2_000 and got[0][3] == 300
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 400_000


def test_hypergeometric_draws_of_any_size(monkeypatch):
    rng = np.random.default_rng(9)
    exact = np.array([sharding.hypergeometric(rng, 400, 700, 300) for _ in range(8000)])
    monkeypatch.setattr(sharding, "LIBRARY_LIMIT", 2)
    ours = np.array([sharding.hypergeometric(rng, 400, 700, 300) for _ in range(8000)])
    spots = np.quantile(exact, [0.05, 0.25, 0.5, 0.75, 0.95])
    assert abs(exact.mean() - ours.mean()) < 0.5 and all(abs((exact <= s).mean() - (ours <= s).mean()) < 0.03 for s in spots)
    assert sharding.hypergeometric(rng, 5, 0, 5) == 5 and sharding.hypergeometric(rng, 0, 5, 5) == 0 and sharding.hypergeometric(rng, 3, 4, 7) == 3
    monkeypatch.undo()
    good, bad, n = 10**12, 39 * 10**12, 10**10
    big = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(1500)], float)
    sd = (n * 0.025 * 0.975 * (1 - n / (good + bad))) ** 0.5
    assert abs(big.mean() - n / 40) < 4 * sd / 1500**0.5 and 0.9 < big.std() / sd < 1.1
    sizes = sharding.shard_sizes(4 * 10**10, 40)
    before = np.array([0, 10**10, 10**10, 3 * 10**10, 4 * 10**10])
    rows = np.array([sharding.matrix_row(before, sizes, i, 5) for i in range(4)])
    assert rows.sum(axis=0).tolist() == sizes.tolist() and rows.sum(axis=1).tolist() == np.diff(before).tolist()


def test_later_models_see_out_of_fold_predictions(monkeypatch):
    """What the second category's model is fitted on are predictions of models that haven't seen the example."""
    from rivulet.llm import toxicity

    rng = random.Random(51)
    texts, junk, bad = [], [], []
    for _ in range(150):
        a, b = rng.random() < 0.4, rng.random() < 0.4
        texts.append(toxicity.features(" ".join([rng.choice("klmnopq") * 3 for _ in range(6)] + ["junk"] * a + ["vile"] * b).encode()))
        junk.append(int(a))
        bad.append(int(b))
    calls, fit = [], toxicity._fit
    monkeypatch.setattr(toxicity, "_fit", lambda bag, use, y, before, **k: calls.append((use.copy(), y, before.copy(), out := fit(bag, use, y, before, **k), bag)) or out)
    chain = toxicity.fit_chain(texts, {"junk": np.array(junk), "bad": np.array(bad)}, folds=5)
    assert len(calls) == 1 + 5 + 1 and len(chain) == 2
    seen = calls[-1][2][:, 0]
    for i, t in enumerate(texts):
        (weights, _, bias), bag = next((out, b) for use, _, before, out, b in calls[1:6] if not use[i])
        z = bias + sum(w for name, w in zip(bag.names.tolist(), weights) if name in set(t.tolist()))
        assert abs(1 / (1 + np.exp(-z)) - seen[i]) < 1e-9
    assert all(sum(not use[i] for use, *_ in calls[1:6]) == 1 for i in range(150))


def test_order_minhash():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    text = [rng.choice(words) for _ in range(300)]
    fp = lambda w: order_minhash.fingerprint(" ".join(w).encode())
    like = lambda a, b: order_minhash.likeness(fp(a), fp(b))
    near, moved = text[:290] + ["z"] * 10, text[150:] + text[:150]
    other = [rng.choice(words) for _ in range(300)]
    assert like(text, text) == 1 and like(text, near) > 0.7 and like(text, other) < 0.1
    assert like(text, moved) < like(text, near)  # the same k-mers in another order
    assert order_minhash.edited("abcdefg", "xy") == "abcdexy" and order_minhash.edited("ab", "xy") == "ab" and order_minhash.edited("abc", "") == "ab"
    assert order_minhash.to_text(order_minhash.from_text(order_minhash.to_text(fp([])))) == order_minhash.to_text(fp([]))


def test_candidates_of_a_split_cell_join_what_brute_force_joins():
    from rivulet.llm.components import least_members

    rng, n = np.random.default_rng(3), 900
    moved = rng.integers(0, 2**32, 40, dtype=np.uint64)[rng.integers(0, 40, n)]
    for _ in range(2):
        moved = moved ^ np.where(rng.random(n) < 0.6, np.uint64(1) << rng.integers(0, 32, n).astype(np.uint64), np.uint64(0))
    checks = np.zeros((n, 2), np.uint64)
    near = np.array([(i, j) for i in range(n) for j in range(i + 1, n) if int(moved[i] ^ moved[j]).bit_count() <= 2])
    want = least_members(near[:, 0], near[:, 1], n)
    for most in (10**9, 4_000, 10):
        pairs = simhash.candidates(moved, np.ones(n, np.int8), 0, checks, most)
        assert (np.bitwise_count(moved[pairs[:, 0]] ^ moved[pairs[:, 1]]) <= 2).all()
        assert len(np.unique(pairs, axis=0)) == len(pairs)
        assert np.array_equal(least_members(pairs[:, 0], pairs[:, 1], n), want)


def test_parity_never_leaves_out_a_similar_pair():
    """At the limit itself too; most pairs that are clearly less similar are left out."""
    rng, out = np.random.default_rng(5), []
    for n in (1, 9, 18, 45, 140, 600, 5000):
        for apart in {0, 1, n // 18, n // 9, n // 9 + 1, n // 5, n // 3, n}:
            for _ in range(6):
                pool = np.unique(rng.integers(0, 2**63, 2 * n + 9, dtype=np.uint64))
                a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[apart:n], pool[n : n + apart // 2]]))
                if np.array_equal(a, b):
                    continue
                (*odd_a, size_a), (*odd_b, size_b) = simhash.parity(a), simhash.parity(b)
                may = bool(simhash.possible(np.array([odd_a]), np.array([odd_b]), np.array([size_a]), np.array([size_b]), 0.8)[0])
                like = simhash.similarity_of(a, b)
                assert (int(size_a), int(size_b)) == (len(a), len(b)) and (may or like < 0.8)
                if n == 140 and like < 0.65:
                    out.append(may)
    assert len(out) >= 12 and np.mean(out) < 0.1
