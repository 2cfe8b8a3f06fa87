"""Every operator over a small table of hard rows, against brute force."""

import hashlib
import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from storeloom.llm import ann, binary, bpe, lines, minhash, neardup, packing, pii, quality, substring, webp
from storeloom.llm.common import Workspace, components
from storeloom.llm.tokens import default_path, tokenizer

WORD, BYTE = default_path("word_bpe_49k.json"), default_path("byte_bpe_50k.json")
PROSE = "the quick brown fox jumps over the lazy dog while seven wise men watch from afar and write all of it down."
PASSAGE = "Every passage that stands in two documents is written out here once more. It has several sentences of a fair length, so that it is found. " + " ".join(f"part{i}" for i in range(30))


def texts():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdeés"), rng.integers(2, 7)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    base = fresh(120)
    parts = base.split()
    near = " ".join([*parts[:60], "changed", *parts[61:]])
    chain = " ".join([*parts[:30], "other", *parts[31:60], "changed", *parts[61:]])
    far = " ".join(x if i % 6 else "zzz" for i, x in enumerate(parts))
    out = [None, "", "   ", "\n\n", base, near, chain, far, base, base.upper(), PROSE, PROSE + "\n" + fresh(30), fresh(40) + "\n" + PROSE, "word", "word", "two words", fresh(30_000), "日本語 <|endoftext|> é", "x\ty\x00z"]
    out += [fresh(20) + " " + PASSAGE + " " + fresh(20), fresh(15) + ". " + PASSAGE + " " + fresh(9), "alpha\nbeta\ngamma", "start\nalpha\nbeta\nend", "alpha\ngamma", "a b c d e f\n\na b c d e f", "mail a@b.co or +1 (555) 010-9999, 10.0.0.1"]
    return out


@pytest.fixture(scope="module")
def rows():
    return [(i * 3, t, "en", "s", None if t is None else len(t), "clash", 7, 0.5) for i, t in enumerate(texts())]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start string, th int, score double"


@pytest.fixture(scope="module")
def docs(spark, rows):
    # columns of its own whose names an operator uses too
    return spark.createDataFrame([*rows, rows[4]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5000, 5000 + i) for i in range(300)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long"))
    found = {r.id: r.component for r in got.collect()}
    assert found == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(Workspace(spark, "t"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_pii(docs, rows, empty):
    got = by_id(pii.find(docs))
    for doc_id, text, *_ in rows:
        base = pii.base_spans(text or "")
        r = got[doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(base[k]) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
    assert [got[25 * 3][c] for c in ("n_email", "n_ip", "n_phone")] == [1, 1, 1]
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    r = by_id(clean)
    assert r[75].text == "mail <email> or <phone>, <ip>" and r[75].n_chars == len(r[75].text) and r[0].text is None and r[30].text == PROSE
    assert pii.find(empty).count() == pii.redact(empty).count() == 0


def brute_classes(rows, threshold=0.8):
    bags = [neardup.bag(t or "") for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        same = (rows[i][1] or "").lower().split() == (rows[j][1] or "").lower().split()
        if same or (len(bags[i][0]) and len(bags[j][0]) and neardup.multiset_jaccard(bags[i], bags[j]) >= threshold):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def test_near_duplicates(spark, docs, rows, empty):
    got = minhash.near_duplicates(spark, docs).collect()
    assert len(got) == len(rows) + 1
    want = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    assert want[15] == want[12] and want[18] == want[12] and want[21] != want[12]
    left = minhash.deduplicate(spark, docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(want.values()))
    assert minhash.near_duplicates(spark, empty).count() == 0


def test_near_duplicates_without_or_with_one_id(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(None, base), (1, base.upper()), (None, "words of its own that no other has"), (5, "a b c d e f g"), (5, "z y x w v u t"), (6, "a b c d e f g")]
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.exact_id, r.class_id, r.n_links) for r in got), key=str) == sorted([(None, 1, 1, 0), (1, 1, 1, 0), (None, None, None, 0), (5, 5, 5, 0), (5, 5, 5, 0), (6, 5, 5, 0)], key=str)


def test_large_groups(spark):
    """Many edited copies whose links to each other don't all lead over their source."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(260):
        copy = list(words)
        for j in rng.integers(0, 100, rng.integers(0, 9)):
            copy[j] = f"e{rng.integers(0, 3)}"
        rows.append((i, " ".join(copy)))
    rows += [(1000 + i, "just the same text in a great many rows") for i in range(300)]
    got = minhash.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_classes(rows[:260]) | {1000 + i: 1000 for i in range(300)}
    wrong = sum(want[r.doc_id] != r.class_id for r in got)
    # a link at the threshold itself is missed with a probability of 5 in 100,000
    assert wrong == 0


@pytest.mark.parametrize("multiset", [True, False])
def test_lookalikes_of_one_bucket(spark, monkeypatch, multiset):
    """Texts that share a form letter and little else are done before texts meet texts; no link is lost."""
    rng = np.random.default_rng(5)
    letter = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(400):
        rows.append((i, " ".join([*letter[:40], *(f"x{rng.integers(1 << 40)}" for _ in range(14)), *letter[40:]])))
    for i in range(60):
        words = rows[rng.integers(0, 400)][1].split()
        words[rng.integers(0, len(words))] = f"y{i}"
        rows.append((1000 + i, " ".join(words * (2 if i % 7 == 0 else 1))))
    # a similarity of 8 / 10, the threshold itself
    tie = [f"t{i}" for i in range(13)]
    rows += [(2000, " ".join(tie)), (2001, " ".join([*tie[:12], "z"]))]
    assert neardup.multiset_jaccard(neardup.bag(rows[-1][1]), neardup.bag(rows[-2][1])) == 0.8
    left = []
    real = neardup._survivors
    monkeypatch.setattr(neardup, "_survivors", lambda *a: left.append(real(*a)) or left[0].cache())
    frame = spark.createDataFrame(rows, "id long, text string")
    ws = Workspace(spark, "t")
    buckets = ws.save(frame.select(F.lit(1).cast("long").alias("key"), "id"), "b")
    cc, links = neardup.classes(ws, buckets, lambda ids: frame.join(ids, "id", "left_semi"), multiset=multiset)
    found = {r.id: r.component for r in cc.collect()}
    bags = [neardup.bag(t) for _, t in rows]
    alike = neardup.multiset_jaccard if multiset else neardup.set_jaccard
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if alike(bags[i], bags[j]) >= 0.8:
            a, b = find(rows[i][0]), find(rows[j][0])
            parent[max(a, b)] = min(a, b)
    sizes = Counter(find(i) for i, _ in rows)
    assert found == {i: find(i) for i, _ in rows if sizes[find(i)] > 1}
    assert all(r.sim >= 0.8 for r in links.collect())
    # those alone in their class are done by their elements beyond the hub's
    assert left[0].count() < 2 * sum(n for n in sizes.values() if n > 1)


def test_elements_beyond_the_hub():
    """What pairs share, and the bound by which a pair must share an element beyond the hub's."""
    rng, inner = np.random.default_rng(6), 0
    for multiset in (True, False):
        long = rng.integers(0, 40, 60)
        # runs of the hub's elements, some of them changed
        own = [np.where(rng.random(60) < rng.choice([0, 0.03, 0.3]), rng.integers(0, 60, 60), long)[a : a + n] for a, n in zip(rng.integers(0, 12, 80), rng.integers(0, 60, 80))]
        hub, *bags = [np.unique(x.astype(np.uint64), return_counts=True) for x in (long, *own)]
        hub, *bags = [(v, c if multiset else np.ones_like(c)) for v, c in (hub, *bags)]
        sizes, found = [int(c.sum()) for _, c in bags], [neardup.beyond(hub, b) for b in bags]
        for b, size, (common, more) in zip(bags, sizes, found):
            assert len(set(more.tolist())) == len(more) == size - common
            assert common == sum(min(int(c), int(hub[1][hub[0] == v].sum())) for v, c in zip(*b))
        for i, j in itertools.combinations(range(len(bags)), 2):
            if sizes[i] + sizes[j] and neardup.multiset_jaccard(bags[i], bags[j]) >= 0.8 and min(found[i][0], found[j][0]) < 0.8 / 1.8 * (sizes[i] + sizes[j]) - 1e-6:
                assert set(found[i][1].tolist()) & set(found[j][1].tolist())
            if sizes[i] + sizes[j] and neardup.multiset_jaccard(bags[i], bags[j]) >= 0.8 and not set(found[i][1].tolist()) & set(found[j][1].tolist()):
                # both reach the other's size, and one shares 8 / 9 of itself with the hub
                assert all(c * 1.8 / 0.8 - n >= m - 1e-6 for c, n, m in ((found[i][0], sizes[i], sizes[j]), (found[j][0], sizes[j], sizes[i])))
                assert any(found[k][0] >= 1.6 / 1.8 * sizes[k] - 1e-6 for k in (i, j))
                inner += 1
    assert inner


def vectors():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 16)).astype(np.float32)
    x[100:300] = x[100]
    x[300] = x[5] * 2
    rows = [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)]
    bad = [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [float("inf")], [None] * 16, [], [1.0] * 4]
    return rows + [(700 + i, b, 0) for i, b in enumerate(bad)], x.astype(float)


def test_neighbours(spark):
    rows, x = vectors()
    got = defaultdict(list)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for r in ann.nearest(spark, frame).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 700, 50))
    hits = 0
    for q in got:
        # scores bit for bit, so ties are ties
        s = ann.cosine(x[q], x)
        s[q] = -9
        want = np.lexsort((np.arange(700), -s))[:5]
        assert [r for r, *_ in got[q]] == [1, 2, 3, 4, 5]
        assert all(s[v] == score for _, v, score in got[q])
        hits += len(set(want.tolist()) & {v for _, v, _ in got[q]})
        assert [v for _, v, _ in got[q]] == sorted([v for _, v, _ in got[q]], key=lambda v: (-s[v], v))
    assert hits >= 0.9 * 5 * len(got)
    # of the vectors that are all one, the smallest ids
    assert [v for _, v, _ in got[100]] == [101, 102, 103, 104, 105] and [v for _, v, _ in got[150]] == [100, 101, 102, 103, 104]
    few = ann.nearest(spark, frame.where("vec_id in (0, 7, 9)")).collect()
    assert sorted(r.vec_id for r in few) == [7, 9]
    assert ann.nearest(spark, frame.where("vec_id >= 700")).count() == 0


def test_neighbours_in_lists_of_two_levels(spark, monkeypatch):
    monkeypatch.setattr(ann, "LISTS", 6)
    x = np.random.default_rng(10).standard_normal((2500, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = defaultdict(set)
    for r in ann.nearest(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 2500, 50):
        s = ann.cosine(x[q], x)
        s[q] = -9
        hits += len(got[q] & set(np.lexsort((np.arange(2500), -s))[:5].tolist()))
    assert hits >= 0.9 * 5 * 50


def test_quality(spark, docs, rows, empty):
    labels = spark.createDataFrame([(r[0], i % 2, 0) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    scored = quality.score(docs, model)
    assert set(docs.columns) <= {*scored.columns} and scored.count() == len(rows) + 1
    assert all(0 <= r.score <= 1 for r in scored.collect())
    held = {r.doc_id for r in docs.where(quality.held_out()).select("doc_id").collect()}
    assert held == {d for d, *_ in rows if zlib.crc32(str(d).encode()) % 5 == 0}
    # labels of held-out rows don't matter
    other = spark.createDataFrame([(r[0], i % 2 if r[0] not in held else 1 - i % 2, 0) for i, r in enumerate(rows)], labels.schema)
    assert np.array_equal(quality.train(docs, other).p["filters"], model.p["filters"])
    assert quality.train(docs, labels.where("quality = 1")) > 0.5
    assert quality.train(empty, labels) == 0.5
    assert quality.score(empty, 0.5).count() == 0


def test_bpe(docs, rows, empty):
    tok = tokenizer(WORD).library
    got = by_id(bpe.encode(docs, WORD))
    digests = by_id(bpe.encode_digests(docs, WORD))
    for doc_id, text, *_ in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        said = tok.decode(ids, skip_special_tokens=False)
        r, d = got[doc_id], digests[doc_id]
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded.decode() == said and r.n_tokens == len(ids)
        assert d.ids_sha256 == hashlib.sha256(r.ids).hexdigest() and d.decoded_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert bpe.encode(empty, WORD).count() == 0
    whole = by_id(bpe.encode(docs, BYTE))
    assert all(whole[d].decoded.decode() == tokenizer(BYTE).library.decode(np.frombuffer(whole[d].ids, "<u4").tolist(), skip_special_tokens=False) for d, *_ in rows)


def brute_repeats(rows, threshold=0.8):
    places = []
    for doc_id, text, *_ in rows:
        for n, line in enumerate((text or "").split("\n")):
            words = line.lower().split()
            if len(words) >= substring.LEAST_WORDS:
                places.append((doc_id, n, 0, len(words), tuple(words)))
    parent = list(range(len(places)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    bags = {p[4]: neardup.bag(" ".join(p[4])) for p in places}
    for i, j in itertools.combinations(range(len(places)), 2):
        a, b = places[i][4], places[j][4]
        if a == b or neardup.set_jaccard(bags[a], bags[b]) >= threshold:
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    groups = defaultdict(list)
    for i, p in enumerate(places):
        groups[find(i)].append(p[:4])
    return {(*p, min(g)[0], min(g)[1], min(g)[2]) for g in groups.values() for p in g if p != min(g)}


def test_repeats(spark, docs, rows, empty):
    frame = docs.dropDuplicates(["doc_id"])
    found = substring.repeats(spark, frame).collect()
    got = {tuple(r[c] for c in ("doc_id", "line", "first", "end", "keep_doc_id", "keep_line", "keep_first")) for r in found}
    units = brute_repeats(rows)
    assert units <= got and all(r.similarity >= neardup.SIMILARITY for r in found)
    assert {(d, n, k) for d, n, a, b, *_ in got for k in range(a, b)} == {(d, n, k) for d, n, a, b, *_ in units for k in range(a, b)} | brute_runs(rows)
    passage = {r[0] for r in got}
    assert 20 * 3 in passage and 19 * 3 not in passage
    left = by_id(substring.remove(spark, frame))
    assert "It has several sentences" in left[57].text and "It has several sentences" not in left[60].text
    assert substring.repeats(spark, empty).count() == 0


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_token_files(spark, docs, rows, empty, path, tmp_path):
    tok = tokenizer(path).library
    binary.write_ids(spark, docs, str(tmp_path / "ids"), path, end_id=0)
    got = sorted(binary.read_ids(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    every = sorted([*rows, rows[4]], key=lambda r: r[0])
    start = 0
    for r, (doc_id, text, *_) in zip(got, every, strict=True):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    whole = [np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for _, t, *_ in every]
    for doc_id in (0, 12, 48, 54):
        found = binary.document(spark, str(tmp_path / "ids"), doc_id)
        assert [x.tolist() for x in found] == [w.tolist() for w, r in zip(whole, every) if r[0] == doc_id]
    flat = np.concatenate(whole)
    for a, n in ((0, 5), (len(whole[0]), 700), (len(flat) - 3, 9), (len(flat) // 2, 40_000)):
        assert (binary.ids_at(spark, str(tmp_path / "ids"), a, n) == flat[a : a + n]).all()
    binary.write_ids(spark, empty, str(tmp_path / "none"), path)
    assert binary.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_packing(spark, docs, rows, empty):
    got = packing.best_fit_pack(spark, docs, WORD, capacity=256).collect()
    tok = tokenizer(WORD).library
    want = Counter()
    for doc_id, text, *_ in [*rows, rows[4]]:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 256):
            want[doc_id, k // 256, k, len(ids[k : k + 256]), zlib.crc32(ids[k : k + 256].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 256) + 1
    assert packing.best_fit_pack(spark, empty, WORD).count() == 0


def test_packing_of_one_doc_id(spark):
    """Rows of one or no doc_id are dealt over regions like any others."""
    rows = [(None if i % 2 else 7, "a few words") for i in range(40_000)]
    found = packing.best_fit_pack(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(4), WORD)
    bins = {r.sequence_id: r for r in found.groupBy("sequence_id").agg({"length": "sum", "offset": "max", "*": "count"}).collect()}
    assert sum(r["count(1)"] for r in bins.values()) == 40_000 and all(r["sum(length)"] <= 2048 for r in bins.values())
    assert len(bins) <= -(-40_000 * 4 // 2040) + 1
    assert len({k // 2 >> 21 for k in bins}) >= 40_000 // packing.REGION


def test_packing_writes_no_states(spark, monkeypatch):
    """Islands and epochs of a search leave no tables: each file that an executor writes starts processes beside it."""
    saved, save = [], Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda ws, df, table: (saved.append(table), save(ws, df, table))[1])
    rng = np.random.default_rng(5)
    rows = [(i, "one " * int(n)) for i, n in enumerate(rng.integers(85, 130, 300))]
    found = packing.best_fit_pack(spark, spark.createDataFrame(rows, "doc_id long, text string"), WORD, capacity=256).collect()
    assert sorted(r.doc_id for r in found) == list(range(300))
    # two of these pieces fill a sequence: no island reaches the bound, so that every epoch is searched
    assert len({r.sequence_id for r in found}) == 150 > -(-sum(r.length for r in found) // 256)
    assert sorted(saved) == ["pieces", "placed", "placed_again"]


def brute_lines(rows, depth=1 << 30):
    """Texts without their repeats, and the repeats: chains of windows of 1, 2, 4, ... lines that are copies with one shift against their first places."""
    texts = {d: [(i, x) for i, x in enumerate((t or "").split("\n")) if x.strip(" \t\r")] for d, t, *_ in rows}
    chains, size = defaultdict(list), 1
    while size <= depth and any(len(x) >= size for x in texts.values()):
        seen = {}
        for d in sorted(texts):
            held, open_ = texts[d], None
            for k in range(len(held) - size + 1):
                first = seen.setdefault(tuple(x for _, x in held[k : k + size]), (d, k))
                if first == (d, k):
                    open_ = None
                elif open_ and (open_[2], open_[3] - open_[0]) == (first[0], first[1] - k):
                    open_[1] = k + size
                else:
                    open_ = [k, k + size, *first]
                    chains[d].append(open_)
        size *= 2
    out, said = {}, {}
    for d, text, *_ in rows:
        enough = {tuple(c) for c in chains[d] if sum(len(x.strip(" \t\r")) for _, x in texts[d][c[0] : c[1]]) >= lines.LEAST_CHARS}
        outer = sorted(c for c in enough if not any(o[:2] != c[:2] and o[0] <= c[0] and c[1] <= o[1] for o in enough))
        gone = {i for a, b, *_ in outer for i, _ in texts[d][a:b]}
        out[d] = "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in gone)
        said[d] = ",".join(f"{a}:{b - a}:{fd}:{fp}" for a, b, fd, fp in outer)
    return out, said


def test_lines(spark, docs, rows, empty):
    want, said = brute_lines(rows)
    got = by_id(lines.report(spark, docs))
    assert {d: r.text_sha256 for d, r in got.items()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}
    assert {d: r.repeats for d, r in got.items()} == said
    left = lines.deduplicate(spark, docs)
    assert left.columns == docs.columns and left.count() == len(rows) + 1
    r = by_id(left)
    assert {d: x.text or "" for d, x in r.items()} == want and r[0].text is None
    assert lines.report(spark, empty).count() == lines.deduplicate(spark, empty).count() == 0


def mixed_runs():
    """Runs of many depths, copied from random places, of lines so short that the depth decides."""
    rng = np.random.default_rng(12)
    source = ["".join(rng.choice(list("abc"), rng.integers(1, 3))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(source, rng.integers(0, 6)))) for i in range(20)]
    rows.append((20, "\n".join(source)))
    for i in range(21, 45):
        parts = []
        for _ in range(rng.integers(1, 4)):
            a, n = rng.integers(0, 50), rng.integers(1, 24)
            parts += source[a : a + n] + (["  "] if rng.random() < 0.3 else []) + [f"only here {i}"] * int(rng.integers(0, 2))
        rows.append((i, "\n".join(parts)))
    rows += [(50, "\n".join(["x"] * 40)), (51, "\n".join(["x"] * 25)), (52, "日本\n語の\n文章は\nここ"), (53, "前\n日本\n語の\n文章は\nここ")]
    return rows


def test_depth_of_lines_decides(spark):
    rows = mixed_runs()
    want, said = brute_lines(rows)
    # the same rule with windows of one and two lines only leaves more
    assert brute_lines(rows, 2)[0] != want and brute_lines(rows, 4)[0] != want
    got = by_id(lines.report(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    assert {d: r.repeats for d, r in got.items()} == said
    assert {d: r.text_sha256 for d, r in got.items()} == {d: hashlib.sha256(t.encode()).hexdigest() for d, t in want.items()}


def test_lines_equal_their_sql(spark):
    import duckdb
    import pandas as pd

    rows = mixed_runs()
    documents = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    want = {r[0]: r for r in duckdb.sql(lines.ORACLE).fetchall()}
    got = {r.doc_id: tuple(r) for r in lines.report(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_suffix_order(spark):
    """Ranks order the suffixes as their sequences of line ids do."""
    rng = np.random.default_rng(7)
    rows = [(i, "\n".join(rng.choice(["a a", "b b", "c c"], rng.integers(0, 12)))) for i in range(25)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    ranks = {r.doc_id: r.rank for r in lines.suffix_ranks(Workspace(spark, "t"), frame).collect()}
    ids = {r.doc_id: list(zip(r.h, r.g)) for r in lines.line_ids(frame.withColumnRenamed("x", "x")).collect()}
    suffixes = [(ids[d][k:], ranks[d][k]) for d in ranks for k in range(len(ranks[d]))]
    for (a, ra), (b, rb) in itertools.combinations(suffixes, 2):
        assert (ra < rb) == (a < b) and (ra == rb) == (a == b)


def test_pictures(docs, rows, empty):
    got = by_id(webp.features(webp.store(docs)))
    for doc_id, text, *_ in rows:
        raw = (text or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r, media = got[doc_id], webp.encode(payload)
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(media))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.media_sha256 == hashlib.sha256(media).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    assert got[12].feature == got[24].feature
    # a long text, in several files
    assert len(webp.files(webp.encode(webp.pad(rows[16][1].encode())))) > 1
    assert webp.features(webp.store(empty)).count() == 0


def test_pipeline(spark, docs, rows, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == docs.columns, name
        assert {(r.start, r.th, r.score) for r in out.collect()} <= {("clash", 7, 0.5)}, name
        out.write.parquet(str(tmp_path / str(i)))
        frame = spark.read.parquet(str(tmp_path / str(i)))
    # one label only: all scores are its share, so nothing goes in the first stage
    lined = brute_lines(rows)[0]
    want = set(brute_classes([(d, lined[d]) for d, *_ in rows]).values())
    assert {r.doc_id for r in frame.collect()} == want
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == want


def test_pipeline_of_two_labels(spark, tmp_path):
    """Each stage of the whole pipeline against what its operator's plain version leaves of the stage before."""
    import corpus_pipeline

    rng = np.random.default_rng(13)
    words = "the river runs past old houses where people walk and talk about their days and nights".split()
    good = [" ".join(rng.choice(words, rng.integers(60, 90))) + "." for _ in range(30)]
    bad = ["### $$$ !!! " * int(rng.integers(20, 60)) for _ in range(30)]
    own = [*good, *bad, good[0], good[1] + "\nAn address: jane [at] site [dot] org", None, "", good[2] + "\n" + good[3]]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(own)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    model = quality.train(frame, labels)
    kept = [r for r in rows if quality.score_texts(model, [r[1] or ""])[0] >= quality.THRESHOLD]
    assert {r[0] for r in kept} >= set(range(30)) and not {r[0] for r in kept} & set(range(30, 60))
    left = brute_lines(kept)[0]
    classes = brute_classes([(d, left[d]) for d, *_ in kept])
    want = {d: left[d] for d in classes.values()}
    got = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, got, str(tmp_path))
        assert got.columns == frame.columns
    got = {r.doc_id: r.text or "" for r in got.collect()}
    assert got == {d: pii.masked(t) for d, t in want.items()} and any("<email>" in t for t in got.values())
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(want)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def brute_runs(rows, size=50):
    """Words, as (doc_id, line, place), of windows of ``size`` words that stand earlier too and don't overlap their first place."""
    first, gone = {}, set()
    for doc_id, text, *_ in sorted(rows, key=lambda r: r[0]):
        words = [(w, n, k) for n, line in enumerate((text or "").split("\n")) for k, w in enumerate(line.lower().split())]
        for a in range(len(words) - size + 1):
            d, b = first.setdefault(tuple(w for w, *_ in words[a : a + size]), (doc_id, a))
            if d != doc_id or a - b >= size:
                gone |= {(doc_id, n, k) for _, n, k in words[a : a + size]}
    return gone


def test_runs_across_lines_and_sentences(spark):
    """Every run of 50 words is removed, whatever its lines and sentences; nothing but runs and whole units goes."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    fresh = lambda n: [word() for _ in range(n)]
    wrapped = lambda words, every: "".join(w + ("\n" if i % every == every - 1 else " ") for i, w in enumerate(words))
    source, rows = fresh(400), []
    rows.append((0, " ".join(source)))
    for k, size in enumerate((49, 50, 51, 55, 60, 80, 120, 50, 50, 70)):
        a = int(rng.integers(0, 400 - size))
        words = fresh(90 + k) + source[a : a + size] + fresh(100)
        # one line, lines of 5, 7 or 11 words, a stop behind every sixth word of the frame
        rows.append((k + 1, " ".join(words) if k % 3 == 0 else wrapped(words, (5, 7, 11)[k % 3])))
    rows.append((20, wrapped(source[100:200], 6).upper()))
    rows.append((21, " ".join(["so"] * 130)))
    rows.append((22, " ".join(fresh(30) + ["so"] * 70 + fresh(30))))
    own = fresh(60)
    rows.append((23, " ".join(own + fresh(20) + own)))
    short = [w + "." if i % 6 == 5 else w for i, w in enumerate(fresh(66))]
    rows += [(24, " ".join(fresh(80) + short + fresh(80))), (25, wrapped(fresh(81) + short + fresh(80), 4))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring.repeats(spark, frame).collect()
    got = {(r.doc_id, r.line, k) for r in found for k in range(r.first, r.end)}
    want = brute_runs(rows)
    assert {d for d, *_ in want} == {*range(2, 11), 20, 21, 22, 23, 25} and want <= got
    units = {(d, n, k) for d, n, a, b, *_ in brute_repeats(rows) for k in range(a, b)}
    assert got == want | units
