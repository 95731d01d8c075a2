"""Operators across rows: dedup, near dedup, mixing, training order, link graph, chats, the pipeline."""

import collections
import ctypes
import gc
import hashlib
import pathlib
import random
import re
import weakref

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldloom.llm import jaccard, op2_training_order, op3_link_graph, op6_simhash, op8_chat, op9_mixing, op10_content_sort
from fieldloom.llm.bpe import encoder
from fieldloom.llm.common import give_back, lean, tokenizer_path, vocabulary
from fieldloom.llm.components import roots
from fieldloom.llm.simhash import fingerprint

WS = re.compile(r"[\x20\x09-\x0D]+")


def docs_of(spark, rows):
    """rows of (doc_id, text); extra columns clash with results."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, Keep_Id int")


ODD = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "ab c "), (5, "ab c "), (None, "abc"), (7, "x" * 200_000), (8, "x" * 100_000 + " " + "x" * 100_000), (9, "abd")]


# Exact dedup


def brute_groups(rows):
    groups = collections.defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[WS.sub("", t or "")].append((-len(t or ""), i is None, i or 0, k, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        out += [(m[4], best[4], len(members), m[3] == best[3], hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(map(repr, out))


def test_exact_groups(spark):
    got = op10_content_sort.exact_groups(docs_of(spark, ODD)).collect()
    assert sorted(map(repr, map(tuple, got))) == brute_groups(ODD)
    assert op10_content_sort.exact_groups(docs_of(spark, []).limit(0)).count() == 0


def test_exact_groups_with_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(op10_content_sort, "WINDOW", 2000)  # many combines
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot  text", "hot text", f"text {rng.randrange(60)}", "shared header " * 9 + str(rng.randrange(9))])) for i in range(900)]
    got = op10_content_sort.exact_groups(docs_of(spark, rows).repartition(7)).collect()
    assert sorted(map(repr, map(tuple, got))) == brute_groups(rows)
    kept = op10_content_sort.keep_first(docs_of(spark, rows).repartition(5))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "Keep_Id"]
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(r.doc_id, dict(rows)[r.doc_id]) for r in got if r.kept}


# Near dedup


def brute_components(fps):
    u = np.array(sorted(set(fps)), np.uint64)
    root = list(range(len(u)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i] ^ u[i + 1 :]) <= 4):
            root[find(i + 1 + int(j))] = find(i)
    return {int(x): find(i) for i, x in enumerate(u)}


def near_rows(n=150, seed=4):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(n):
        words = list(base) if i % 2 else [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = f"W{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    return rows + [(500, None), (501, ""), (3, rows[3][1]), (502, "one"), (503, "ONE")]


@pytest.mark.parametrize("heavy", [4096, 2])
def test_components_against_brute_force(spark, heavy):
    rows = near_rows()
    fp = [fingerprint(t) for _, t in rows]
    root = brute_components(fp)
    least = {}
    for (i, _), x in zip(rows, fp, strict=True):
        least[root[x]] = min(least.get(root[x], i), i)
    want = sorted((i, f"{x:016x}", least[root[x]]) for (i, _), x in zip(rows, fp, strict=True))
    got = op6_simhash.near_duplicates(docs_of(spark, rows), heavy=heavy)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == want
    assert len({c for _, _, c in want}) < len(want) - 40
    kept = op6_simhash.keep_one(docs_of(spark, rows), heavy=heavy)
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in want} and "Keep_Id" in kept.columns


def test_links_are_complete_for_close_fingerprints(spark):
    rng = random.Random(7)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        fps |= {x, *(x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(6))}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4}
    for n in (None, 10**7):
        got = op6_simhash.links(spark.createDataFrame([(x,) for x in signed], "x long"), n=n).collect()
        assert sorted((r.a, r.b) for r in got) == sorted(want)  # each once


@pytest.mark.parametrize("layout", [(1, 1), (2, 4), (2, 3), (3, 2), (7, 2), (2, 1)])
def test_links_on_grids_of_grouped_blocks(spark, monkeypatch, layout):
    rng = random.Random(sum(layout))
    xs = [rng.getrandbits(64) for _ in range(40)]
    fps = {*xs, *(x ^ sum(1 << b for b in rng.sample(range(64), k)) for x in xs for k in (1, 2, 4, 4, 5))}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    monkeypatch.setattr(op6_simhash, "blocks_for", lambda n, distance: layout)
    got = op6_simhash.links(spark.createDataFrame([(x,) for x in signed], "x long")).collect()
    assert sorted((r.a, r.b) for r in got) == sorted(want)  # each once


def test_copies_of_fingerprints_grow_in_small_steps(spark):
    fps = spark.createDataFrame([(1,)], "x long")
    copies = lambda n: op6_simhash.links(fps, n=n)._jdf.queryExecution().analyzed().toString().count("struct(grid")
    for n in (41_650, 51_282):  # check_s and check_l
        assert 0 < copies(5 * n) <= 2 * copies(n)


def plain_fingerprint(text):
    """The contract's fingerprint, bit by bit."""
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_against_plain_ones(monkeypatch):
    from fieldloom.llm import simhash

    rng = random.Random(2)
    texts = [None, "", " \t\x0b", "one", "É A b\x0c\x1cC", "x" * 100_000, "a b c d " * 5000, "\xa0 \u2003 İ ẞ"]
    texts += ["".join(rng.choice("aB é\n\t\x1c  ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    want = [plain_fingerprint(t) for t in texts]
    assert [fingerprint(t) for t in texts] == want
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert [fingerprint(t) for t in texts] == want


def test_embedding_is_a_lower_bound(spark):
    rng = random.Random(3)
    pairs = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(300)]
    pairs += [(x, x ^ sum(1 << b for b in rng.sample(range(64), k))) for x, _ in pairs[:50] for k in (0, 1, 2, 4, 5)]
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(i, sign(a), sign(b)) for i, (a, b) in enumerate(pairs)], "i int, a long, b long")
    e = lambda c: op6_simhash.embedding(F.col(c))
    count = lambda x, k: (x >> 2 * k & 3).bit_count()
    for r in frame.select("i", op6_simhash.manhattan(e("a"), e("b")).alias("d")).collect():
        a, b = pairs[r.i]
        assert r.d == sum(abs(count(a, k) - count(b, k)) for k in range(32)) <= (a ^ b).bit_count()


def test_one_row_of_each_component_stays(spark):
    """Rows that share the smallest id, with the same text or another one, are one after near dedup."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (1, text), (1, text + " more"), (2, text), (None, text), (9, "quite another text of these")]
    for keep in (op6_simhash.keep_similar, lambda d: op6_simhash.keep_one(d, distance=16)):
        got = collections.Counter(r.doc_id for r in keep(docs_of(spark, rows)).collect())
        assert got == {1: 1, None: 1, 9: 1}


def test_near_dedup_edges(spark):
    got = {r.doc_id: r for r in op6_simhash.near_duplicates(docs_of(spark, [(None, "a b c d e"), (1, None)])).collect()}
    assert got[1].fingerprint == "0" * 16 and got[None].component_id is None and not got[None].kept
    assert op6_simhash.near_duplicates(docs_of(spark, []).limit(0)).count() == 0
    assert fingerprint("A b  c\nD") == fingerprint("a b c d") and fingerprint(" ") == 0


def test_near_copies_at_the_threshold_are_dropped(spark):
    rng = random.Random(5)
    rows = []
    for k in range(12):  # copies with one to five words replaced: similarity 0.95 to 0.82, and 0.77
        words = [f"w{rng.randrange(10**5)}" for _ in range(200)]
        rows.append((10 * k, " ".join(words)))
        for v in range(1, 4 + k % 3):
            other = list(words)
            for at in range(v):
                other[10 + 20 * at] = f"X{k}{v}{at}"
            rows.append((10 * k + v, " ".join(other)))
    rows += [(500 + i, "shared start of every one of these texts " * 2 + " ".join(f"q{i}r{j}" for j in range(12 - i % 3))) for i in range(30)]
    rows += [(600, rows[0][1].upper()), (601, "a b c"), (602, "A  b c"), (603, None), (604, ""), (None, rows[1][1]), (605, "a b c d")]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset() for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted(repr(i) for (i, _), r in zip(rows, root, strict=True) if i is None or least[r] == i)
    docs = docs_of(spark, rows)
    for small in (jaccard.SMALL, 1):
        kept = jaccard.keep_one(docs, small=small)
        assert sorted(repr(r.doc_id) for r in kept.collect()) == want and kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want
    assert len(want) < len(rows) - 30


@pytest.mark.parametrize("small", [jaccard.SMALL, 1])
def test_bands_go_on_from_the_components_of_the_links(spark, monkeypatch, small):
    rng = random.Random(21)
    rows = []
    for k in range(4):  # a group of close copies, of which SimHash links many, and distant ones
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows += [(100 * k + v, " ".join([*words, f"end{k}x{v}"])) for v in range(12)]
        rows += [(100 * k + 50 + v, " ".join(f"x{v}" if i % 61 == v else w for i, w in enumerate(words))) for v in range(3)]
    calls, verified = [], jaccard._verified

    def recorded(pairs, sets):
        out = verified(pairs, sets)
        calls.append(({tuple(r) for r in pairs.collect()}, {tuple(r) for r in out.collect()}))
        return out

    monkeypatch.setattr(jaccard, "_verified", recorded)
    ids = lambda kept: sorted(r.doc_id for r in kept.collect())
    alone = ids(jaccard.keep_one(docs_of(spark, rows), small=small, propose=lambda fps: fps.select(F.col("x").alias("a"), F.col("x").alias("b")).limit(0)))
    by_bands = {p for c in calls for p in c[0]}
    calls.clear()
    assert ids(op6_simhash.keep_similar(docs_of(spark, rows), small=small)) == alone == [0, 100, 200, 300]
    root = {}
    for a, b in calls[0][1]:
        old, new = root.get(a, a), root.get(b, b)
        root |= {x: new for x in [a, b, *root] if root.get(x, x) == old}
    later = [p for c in calls[1:] for p in c[0]]
    assert not by_bands <= calls[0][0]  # the links go first, alone
    assert root and all(root.get(a, a) != root.get(b, b) for a, b in later)
    assert 0 < len(later) < len(by_bands)


def test_rare_shingles_find_every_near_pair_of_different_roots(spark, monkeypatch):
    """Against all pairs: distant copies of one text, texts that share a passage, and ties of frequency."""
    rng = random.Random(11)
    core = [rng.getrandbits(62) for _ in range(60)]
    sets = [frozenset(h for h in core if rng.random() > p) | {rng.getrandbits(62) for _ in range(rng.randrange(1 + int(60 * p)))} for p in (0.02, 0.1, 0.2, 0.4) for _ in range(30)]
    sets += [frozenset(core[:40] + [rng.getrandbits(62) for _ in range(k % 12)]) for k in range(30)] + [frozenset([5]), frozenset([5, 6]), frozenset(range(5)), frozenset(range(4))]
    rows = [(x, len(v), x if x % 3 else -1) for x, v in enumerate(sets)]
    packed = [(x, len(v), bytearray(np.array(sorted(v), np.int64).tobytes())) for x, v in enumerate(sets)]
    rest, table = spark.createDataFrame(rows, "x long, n long, root long"), spark.createDataFrame(packed, "x long, n long, s binary")
    pairs = {(a, b) for b in range(len(sets)) for a in range(b) if rows[a][2] != rows[b][2]}
    near = {(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    got = jaccard._sharing_rare(rest, table)
    found = {(r.a, r.b) for r in got.collect()}
    assert near and near <= found <= pairs and len(found) < len(pairs) / 2
    assert {(r.a, r.b) for r in jaccard._verified(got, table).collect()} == near
    assert jaccard._sharing_rare(rest.limit(0), table).count() == 0
    monkeypatch.setattr(jaccard, "HOT", 3)  # every shingle of the core over many cells
    assert {(r.a, r.b) for r in jaccard._sharing_rare(rest, table).collect()} == found


def test_roots_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)]
    got = {r.node: r.root for r in roots(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert len(got) == 303 and len({got[i] for i in range(301)}) == 1 and got[1000] == got[1001] != got[0]
    assert roots(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_merge_components(spark):
    own = spark.createDataFrame([(1, 1), (2, 1), (3, 4), (4, 4), (8, 9), (9, 9)], "node long, root long")
    links = spark.createDataFrame([(2, 3), (3, 6), (20, 21), (1, 2)], "a long, b long")
    groups = collections.defaultdict(set)
    for r in jaccard._merged(own, links).collect():
        assert r.node not in groups[r.root]
        groups[r.root].add(r.node)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3, 4, 6], [8, 9], [20, 21]]
    assert {tuple(r) for r in jaccard._merged(own, links.limit(0)).collect()} == {tuple(r) for r in own.collect()}


# Mixing


def mix_rows(n=300, seed=3):
    rng = random.Random(seed)
    return [(i, " \n".join(["w"] * rng.randint(0, 40)), "en", rng.choice(["a", "b", "c", "d", None, "é"]) if i % 3 else "a", 1, 0) for i in range(n)]


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and weight[s] * left / share > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else weight[s] * left / share for s in order}
        full |= over


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, taken int"


def test_mix(spark):
    rows = mix_rows()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    want = brute_targets(dict(sizes))
    docs = spark.createDataFrame(rows, SCHEMA)
    got = op9_mixing.mix(docs).collect()
    assert len(got) == len(rows)
    source, taken = {r[0]: r[3] for r in rows}, collections.Counter()
    for r in got:
        s = source[r.doc_id]
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s] and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, op9_mixing.mix(docs.repartition(9)).collect())) if all(r.position is not None for r in got) else True
    assert sorted(map(repr, got)) == sorted(map(repr, op9_mixing.mix(docs.repartition(9)).collect()))
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places)
    made = op9_mixing.materialise(docs)
    assert made.columns == docs.columns
    assert collections.Counter(source[r.doc_id] for r in made.collect() for _ in r.text.split()) == taken


def test_mix_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame(mix_rows(), SCHEMA)
    want = sorted(map(repr, op9_mixing.mix(docs).collect()))
    monkeypatch.setattr(op9_mixing, "BLOCK_DOCS", 5)
    assert sorted(map(repr, op9_mixing.mix(docs).collect())) == want


def test_schedule_is_inverted(spark):
    for knots in op9_mixing.SCHEDULE.values():
        rows = spark.range(101).select((F.col("id") / 100).alias("u"), op9_mixing.inverse(F.col("id") / 100, knots).alias("t")).collect()
        parts = op9_mixing.segments(knots)
        for r in rows:
            t0, w0, slope, before, total = [p for p in parts if p[0] <= r.t][-1]
            assert before + w0 * (r.t - t0) + slope * (r.t - t0) ** 2 / 2 == pytest.approx(r.u * total, abs=1e-9)


def test_mix_with_other_weights_and_schedules(spark):
    """Weights without a schedule of their own name, a source's own schedule, ids all null, equal sizes, one very long text."""
    rows = [(None, f"w{i % 50} x y", "", "ab"[i % 2], 1, 0) for i in range(400)] + [(None, "z " * 60_000, "", "c", 1, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    late = ((0.0, 0.0), (1.0, 2.0))
    for repeat in (3, 11):
        got = op9_mixing.mix(docs.repartition(repeat), weights=(4, 3), by_source={"b": late})
        found = got.collect()
        assert len(found) == 401 and all((r.position is None) == (r.taken == 0) for r in found)
        made = op9_mixing.materialise(docs.repartition(repeat), weights=(4, 3), by_source={"b": late})
        texts = [(r.source, r.text) for r in made.collect()]
        if repeat == 3:
            first = sorted(texts)
        assert sorted(texts) == first  # also where the cut falls
    with pytest.raises(ValueError, match="schedule"):
        op9_mixing.mix(docs, schedules=())
    with pytest.raises(ValueError, match="schedule"):
        op9_mixing.mix(docs, by_source={"a": ((0.0, 1.0), (0.5, 1.0))})


def test_targets_of_many_sources(spark):
    rng = random.Random(4)
    for n in (1, 2, 7, 40, 333):
        sizes = {(f"h{rng.randrange(10**6)}" if k else None): rng.choice([0, 1, 5, 10, 1000, 10**7]) for k in range(n)}
        frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in op9_mixing.targets(frame).collect()}
        if sum(sizes.values()):
            want = brute_targets(sizes)
            assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-12) for s in want)


def test_mix_edges(spark):
    docs = spark.createDataFrame([(1, None, "", "a", 0, 0), (2, "", "", None, 0, 0), (None, "x y", "", "b", 3, 0), (4, "x y", "", "b", 3, 0), (4, "x y", "", "b", 3, 0)], SCHEMA)
    got = op9_mixing.mix(docs).collect()
    assert sum(r.taken for r in got) == 6 and {(r.size, r.taken, r.position) for r in got if r.size == 0} == {(0, 0, None)}
    assert op9_mixing.mix(docs.limit(0)).count() == 0 and op9_mixing.materialise(docs.limit(0)).count() == 0


# Training order


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(op2_training_order.permute(np.arange(n), n).tolist()) == list(range(n))
    a, b = (op2_training_order.permute(np.arange(1000), 1000, key) for key in (1, 2))
    assert (a != b).mean() > 0.9 and (a != np.arange(1000)).mean() > 0.9


def test_shards(spark, tmp_path):
    import public_tokenizers as P

    ranks = tokenizer_path("byte_bpe_50k.tiktoken")
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "\n", "é", "beta"]) for _ in range(rng.randint(0, 120)))) for i in range(60)] + [(70, None), (71, "z" * 50_000), (3, "twice"), (None, "nobody")]
    encoding, _ = op2_training_order._encoding(ranks, P.PATTERN)
    want = collections.Counter()
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        want.update((np.iinfo(np.int64).min if i is None else i, k // 16, tuple(ids[k : k + 16])) for k in range(0, len(ids), 16))
    m = op2_training_order.materialise(docs_of(spark, rows), ranks, P.PATTERN, f"{tmp_path}/s", length=16, shard_bytes=900)
    got = op2_training_order.read_slots(spark, f"{tmp_path}/s").collect()
    assert m["n"] == len(got) and sorted(r.slot for r in got) == list(range(m["n"]))
    assert collections.Counter((r.doc_id, r.seq, tuple(r.ids)) for r in got) == want
    part = op2_training_order.read_slots(spark, f"{tmp_path}/s", 25, 91).collect()
    assert sorted(part) == sorted(r for r in got if 25 <= r.slot < 91)
    for f in (tmp_path / "s").rglob("part-*"):
        assert f.stat().st_size % m["stride"] == 0 and f.stat().st_size <= m["slots"] * m["stride"]
    empty = op2_training_order.materialise(docs_of(spark, [(1, "")]), ranks, P.PATTERN, f"{tmp_path}/e", length=16)
    assert empty["n"] == 0 and op2_training_order.read_slots(spark, f"{tmp_path}/e").count() == 0


def test_slots_do_not_depend_on_files(spark, tmp_path):
    """The same slots for another layout of the input and another number of ranges, under a folder that looks like a shard, whose
    groups hold several shards each."""
    import public_tokenizers as P

    rng = random.Random(3)
    rows = [(i if i % 9 else None, " ".join(rng.choice(["alpha", "é", "beta"]) for _ in range(rng.randint(0, 50)))) for i in range(120)]
    docs = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], "doc_id long, text string, Slot int, seq string, first double")
    found = []
    for k, (n, shuffled) in enumerate([(2, "4"), (7, "3")]):
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        path = f"{tmp_path}/part-7/wave=3/s{k}"
        m = op2_training_order.materialise(docs.repartition(n), tokenizer_path("byte_bpe_50k.tiktoken"), P.PATTERN, path, length=8, shard_bytes=400, waves=2)
        assert m["per_task"] > 1 and -(-m["n"] // m["slots"]) > 8
        found.append({r.slot: (r.doc_id, r.seq, tuple(r.ids)) for r in op2_training_order.read_slots(spark, path).collect()})
        assert len(found[-1]) == m["n"]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_wide_ids_come_from_the_table(spark, tmp_path):
    import base64

    table = [bytes([b]) for b in range(256)] + [b"%05d" % i for i in range(66_000 - 256)]
    path = tmp_path / "big.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % (65_999 - i if i < 256 else i - 256) for i, t in enumerate(table)))
    docs = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    m = op2_training_order.materialise(docs, str(path), r"\S+|\s+", f"{tmp_path}/w", length=8)
    got = [i for r in op2_training_order.read_slots(spark, f"{tmp_path}/w").orderBy("seq").collect() for i in r.ids]
    assert m["wide"] and got == [65_999 - b for b in b"hello world"]


# Link graph


def brute_rank(nodes, edges, seeds, rounds, damping=0.85):
    total = sum(seeds.values())
    start = {n: seeds.get(n, 0) / total if total else 0.0 for n in nodes}
    out = collections.Counter()
    for (a, _), w in edges.items():
        out[a] += w
    now = dict(start)
    for _ in range(rounds):
        new = {n: start[n] * (1 - damping) for n in nodes}
        for (a, b), w in edges.items():
            new[b] += damping * now[a] * w / out[a]
        now = new
    total = sum(now.values())
    return {n: v / total if total else 0.0 for n, v in now.items()}


def test_trust_and_distrust(spark):
    rng = random.Random(6)
    nodes = [f"h{i}" for i in range(25)]
    edges = collections.Counter((rng.choice(nodes[:20]), rng.choice(nodes)) for _ in range(90))
    edges = {e: float(n) for e, n in edges.items() if e[0] != e[1]}
    trust, distrust = {"h1": 1.0, "h2": 0.5}, {"h7": 0.25}
    seeds = spark.createDataFrame([(n, trust.get(n, 0.0), distrust.get(n, 0.0)) for n in nodes[:18]], "host string, trust double, distrust double")
    frame = spark.createDataFrame([(*e, n) for e, n in edges.items()], "src string, dst string, links double")
    got = {r.host: r for r in op3_link_graph.propagate(seeds, frame, rounds=6).collect()}
    every = {*nodes[:18], *(x for e in edges for x in e)}
    want_t = brute_rank(every, edges, trust, 6)
    want_d = brute_rank(every, {(b, a): n for (a, b), n in edges.items()}, distrust, 6)
    assert set(got) == every
    for n in every:
        assert got[n].trust == pytest.approx(want_t[n]) and got[n].distrust == pytest.approx(want_d[n])


def brute_judge(pages, rules, threshold=1.0):
    """Verdicts of the rules and of the graph, with plain loops."""
    def parts(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path

    def rule(host, path):
        hits = [(len(r), v == "block", r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        return max(hits)[2:] if hits else (None, None)

    rows = [(i, *parts(u), h or "") for i, u, h in pages]
    n, allowed, blocked, edges = (collections.Counter() for _ in range(4))
    for _, host, path, html in rows:
        if host:
            n[host] += 1
            allowed[host] += rule(host, path)[1] == "allow"
            blocked[host] += rule(host, path)[1] == "block"
            for to in re.findall(r'href="https?://([^/"]+)', html):
                if to.lower() != host:
                    edges[host, to.lower()] += 1.0
    nodes = {*n, *(x for e in edges for x in e)}
    trust = brute_rank(nodes, edges, {h: allowed[h] / n[h] for h in n}, 200)
    distrust = brute_rank(nodes, {(b, a): w for (a, b), w in edges.items()}, {h: blocked[h] / n[h] for h in n}, 200)
    out = []
    for i, host, path, _ in rows:
        r, v = rule(host, path)
        bad = host in nodes and distrust[host] * len(nodes) >= threshold and distrust[host] > trust[host]
        out.append((i, host, path, r, v or ("block" if bad else "allow")))
    return out


def test_judge_against_brute_force(spark):
    """A graph of absolute links with a hub, chains longer than 20 links from a seed, long urls and pages."""
    rng = random.Random(11)
    hosts = [f"h{i}.{t}" for i in range(30) for t in ("com", "net", "org")] + ["example.com", "a.example.net"]
    paths = ["/en/1", "/en/7", "/de/1", "/de/8", "/es/2", "/other", "", "/en/7" + "x" * 100_000]
    pages = []
    for i in range(400):
        own, to = rng.choice(hosts), ["hub.info", *rng.sample(hosts, rng.randint(0, 3))]
        pages.append((i, f"http://{own}{rng.choice(paths)}", " ".join(f'<a href="http://{t}/x">' for t in to)))
    pages += [(1000 + i, f"http://c{i}.info/", f'<a href="https://C{i + 1}.info/">' * 2 + "t" * (300_000 if i == 3 else 0)) for i in range(40)]
    pages += [(1040, "http://c40.info/", '<a href="http://spam.org/">'), (1041, "http://spam.org/es/", None), (1042, None, "x"), (1043, "nowhere", "x")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = sorted(tuple(r) for r in op3_link_graph.judge(frame, tolerance=1e-5).select("page_id", "host", "path", "rule", "verdict").collect())
    want = sorted(brute_judge(pages, op3_link_graph.RULES))
    assert got == want
    graph_only = [w for w in want if w[3] is None]
    assert {w[4] for w in graph_only} == {"allow", "block"}


def test_long_chains_converge(spark):
    """Trust reaches a host 30 links away."""
    frame = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1.0) for i in range(30)], "src string, dst string, links double")
    seeds = spark.createDataFrame([("n0", 1.0, 0.0)], "host string, trust double, distrust double")
    got = {r.host: r.trust for r in op3_link_graph.propagate(seeds, frame).collect()}
    want = brute_rank({f"n{i}" for i in range(31)}, {(f"n{i}", f"n{i + 1}"): 1.0 for i in range(30)}, {"n0": 1.0}, 300)
    assert got["n30"] > 0 and all(got[h] == pytest.approx(want[h], abs=1e-6) for h in want)


def test_link_verdicts(spark):
    rows = [
        (1, "http://A.Example.COM/en/1", ""), (2, "http://a.example.com/en/7/x", ""), (3, "http://example.net/de/8", ""), (4, "http://b.net/de/1?q", ""),
        (5, "http://friend.org/", "<a HREF='//sub.spam.org/'> <a href=https://Spam.org>"), (6, "http://spam.org/es/1", ""), (7, "http://spam.org/other", ""), (8, "no url", "<a href='http://x.org'>"),
        (9, None, None), (10, "ftp://q://z/e", ""), (11, "http://notcom/en/", ""), (12, "http://com/en/", ""), (12, "http://com/en/", ""), (13, "http://calm.org/", "<a href='/local'>"),
    ]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, verdict int")
    got = {r.page_id: r for r in op3_link_graph.judge(pages).collect()}
    assert [(got[i].host, got[i].rule, got[i].verdict) for i in (1, 2, 3, 4)] == [("a.example.com", "com/en/", "block"), ("a.example.com", "example.com/en/7", "allow"), ("example.net", "example.net/de/8", "block"), ("b.net", "net/de/", "allow")]
    assert (got[6].rule, got[7].rule, got[7].verdict) == ("org/es/", None, "block")  # the host is half blocked
    assert got[5].distrust > 0 and (got[8].host, got[8].path, got[8].verdict) == ("", "", "allow") and got[9].verdict == "allow"
    assert (got[10].host, got[10].path) == ("q:", "//z/e") and got[11].rule is None and got[12].rule == "com/en/" and got[13].verdict == "allow"
    assert op3_link_graph.judge(pages).count() == len(rows) and op3_link_graph.judge(pages.limit(0)).count() == 0
    assert "Arrow" not in op3_link_graph.judge(pages)._jdf.queryExecution().executedPlan().toString()


# Chats


def brute_chat(turns):
    said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
    loss = "".join(t for _, r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chats_round_trip(spark):
    rng = random.Random(9)
    bits = ["<turn>", "</turn>\n", "<text>", "\\", "\\b", "\\l", "<", "é😀", " ", "\n", "<image:0>", "ok"]
    rows = [(c, t, rng.choice(["user", "assistant", "sys<tem\\"]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))) for c in (1, 2, None) for t in range(8)]
    rows += [(4, 0, None, None), (4, None, "assistant", "first"), (5, 1, "assistant", "same"), (5, 1, "assistant", "same")]
    turns = spark.createDataFrame([(*r, 3) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    chats = op8_chat.format_chats(turns.withColumn("parts", op8_chat.text_parts(F.col("text"))))
    got = {r.conv_id: tuple(r)[1:5] for r in op8_chat.digests(chats).collect()}
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    assert got == {c: brute_chat(sorted(ts)) for c, ts in by.items()}
    empty = turns.limit(0).withColumn("parts", op8_chat.text_parts(F.col("text")))
    assert op8_chat.digests(op8_chat.format_chats(empty)).count() == 0


def test_typed_parts(spark):
    part = lambda kind, **kw: (kind, kw.get("text"), kw.get("ref"), kw.get("width"), kw.get("height"), kw.get("seconds"), kw.get("pages"))
    parts = [part("text", text="see <this>"), part("image", ref="a.png", width=57, height=28), part("audio", ref="b.wav", seconds=1.01), part("text", text=" and "), part("document", ref="c.pdf", pages=3), part("video", ref="d"), part(None)]
    rows = [(1, 0, "assistant", parts), (1, 1, "user", None), (1, 2, "assistant", [])]
    chats = op8_chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {op8_chat.PARTS}"))
    r = chats.first()
    assert r.formatted == "<turn>assistant<text>see \\lthis><image:0><audio:1> and <document:2><file:3><file:4></turn>\n<turn>user<text></turn>\n<turn>assistant<text></turn>\n"
    assert [(a.turn, a.k, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, 0, "image", "a.png", 3), (0, 1, "audio", "b.wav", 26), (0, 2, "document", "c.pdf", 768), (0, 3, "file", "d", 0), (0, 4, "file", None, 0)]
    assert r.attachment_tokens == 797
    assert chats.select(op8_chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("t")).first().t == "see <this> and "


def test_many_parts_and_long_texts(spark):
    """A turn of many parts, texts of a million characters, a conversation of many turns, and ties that escaping would reorder."""
    part = lambda kind, text=None: (kind, text, None, 1, 1, 0.0, 1)
    many = [part("text", "a<b\\") if i % 2 else part(("image", "audio", "document", "other")[i // 2 % 4]) for i in range(6000)]
    huge = "<x \\l" * 200_000
    rows = [(1, 0, "user", many), (2, 0, "assistant", [part("text", huge)]), (4, 0, "user", [part("text", "a=")]), (4, 0, "user", [part("text", "a<")])]
    rows += [(3, k, "assistant" if k % 2 else "user", [part("text", f"turn {k}")]) for k in range(4000)]
    chats = op8_chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {op8_chat.PARTS}").repartition(5))
    got = {r.conv_id: r for r in chats.collect()}
    kinds = [m for m in re.findall(r"<(image|audio|document|file):(\d+)>", got[1].formatted)]
    assert [int(k) for _, k in kinds] == list(range(3000)) == [a.k for a in got[1].attachments]
    assert [k for k, _ in kinds] == [a.kind for a in got[1].attachments]
    said = {r.conv_id: tuple(r)[1:5] for r in op8_chat.digests(chats).collect()}
    assert said[2] == brute_chat([(0, "assistant", huge)])
    assert said[3] == brute_chat([(k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(4000)])
    assert said[4] == brute_chat([(0, "user", "a<"), (0, "user", "a=")])


# Pipeline


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def plainly_good(text):
    """The quality rule with plain loops: 50 words, half of them outside repeated 3-word windows, at most 40 % of them in repeats of
    8 words or more, no repeat over 150."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)

    def inside(size):
        """Words in windows of this size that the text holds twice or more."""
        places = collections.defaultdict(list)
        for i in range(n - size + 1):
            places[tuple(words[i : i + size])].append(i)
        return {i + k for at in places.values() if len(at) > 1 for i in at for k in range(size)}

    return n >= 50 and 100 * len(inside(3)) <= 50 * n and 100 * len(inside(8)) <= 40 * n and not inside(151)


def five_words(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_pipeline_against_brute_force(spark, tmp_path):
    import tokenizers

    rng = random.Random(12)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    texts = [fresh(rng.randint(40, 120)) for _ in range(60)]
    texts += [t.replace(" ", "  ") for t in texts[:10]] + [t + " extra" for t in texts[10:20]] + ["bad " * 80, None, ""]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()

    good = [r for r in rows if plainly_good(r[1] or "")]
    best = {}
    for r in good:
        key = WS.sub("", r[1])
        best[key] = min(best.get(key, r), r, key=lambda x: (-len(x[1]), x[0]))
    distinct = sorted(best.values())
    sets = [five_words(r[1]) for r in distinct]
    group = list(range(len(distinct)))
    for i in range(len(distinct)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    left = [r for k, r in enumerate(distinct) if group.index(group[k]) == k]  # the smallest id of each group
    sizes = collections.Counter()
    for r in left:
        sizes[r[3]] += len(r[1].split())
    library, want = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), collections.Counter()
    for s, target in brute_targets(dict(sizes)).items():
        due = int(target + 0.5)
        own = sorted((r for r in left if r[3] == s), key=lambda r: md5(str(r[0]) + md5(r[1])))
        while due > 0:
            for r in own:
                words = r[1].split()
                take = min(due, len(words))
                if take > 0:
                    text = r[1] if take == len(words) else " ".join(words[:take])
                    want[r[0], hashlib.sha256(text.encode()).hexdigest(), len(library.encode(text, add_special_tokens=False).ids)] += 1
                due -= take
    assert collections.Counter((r.doc_id, r.decoded_sha256, r.n_tokens) for r in out) == want
    assert len(left) < len(distinct) < len(good) < len(rows)


def test_a_worker_keeps_the_caches_of_one_operator_only():
    """Worker processes outlive the stages of the pipeline, and count as memory of their executor."""
    of = vocabulary(tokenizer_path("byte_bpe_50k.json"))
    first = weakref.ref(encoder(of))
    assert first() is not None and encoder(of) is first()  # kept from batch to batch
    assert jaccard._packed.func(pa.array(["a b c d e", None])).to_pylist() == [jaccard.shingles("a b c d e").tobytes(), b""]
    gc.collect()
    assert first() is None
    assert encoder(of).encode("a b") == encoder(of).encode("a b")


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="glibc only")
def test_a_worker_returns_its_free_memory():
    def resident():
        return int(re.search(r"VmRSS:\s+(\d+)", pathlib.Path("/proc/self/status").read_text())[1]) / 1024

    give_back()
    before, peak = resident(), []

    @lean("test")
    def batch(column):
        parts = [np.ones(12_000, np.uint8) for _ in range(8_000)]  # too small for maps of their own
        kept["last"] = parts[-1]  # on top of the heap
        peak.append(resident())
        return column

    kept = {}
    assert batch(pa.array([1])).to_pylist() == [1]
    assert peak[0] - before > 60 and resident() - before < 30


def test_stages_keep_the_columns(spark):
    docs = spark.createDataFrame([(i, f"a{i} " * 3 + " ".join(f"w{i}{k}" for k in range(60)), "en", "s", 9) for i in range(8)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "near dedup", "mixing", "bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").schema.names == docs.schema.names
        assert stage(spark, docs.limit(0), "").count() == 0
