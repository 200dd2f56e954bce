"""The operators on documents against plain versions, on texts with every awkward case in them."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from stratalog.llm import decontam, lines, packing, quality, sharding, simhash, substrings

SCHEMA = "k1 string, doc_id long, label string, text string, spans int, fp long, n int, __row int"


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(words))


def texts() -> list[tuple]:
    """(doc_id, text): copies, near copies, shared lines and passages, nulls, empties, ties, repeated rows, a long text."""
    rng = random.Random(3)
    base = [prose(rng, rng.randint(3, 160)) for _ in range(40)]
    line, passage = "  A Line That Many Documents Hold\t", prose(rng, 120)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100 + i, base[i]) for i in range(6)] + [(110 + i, base[7]) for i in range(4)]
    out += [(120 + i, base[i].replace(" ", "  ", 1).upper()) for i in range(4)]
    out += [(130 + i, f"{base[i]}\n{line}\nshort\n{base[i + 1][:60]}\n{line.strip().lower()}") for i in range(5)]
    out += [(140 + i, f"{prose(rng, 20)} {passage} {prose(rng, 15)}") for i in range(5)]
    out += [(150, prose(rng, 6000)), (151, None), (152, ""), (153, "\n\n"), (154, " \t"), (155, "é" * 450), (156, "é" * 450), (157, "ab" * 500), (None, base[3]), (None, None), (2, base[2]), (2, base[2]), (3, "another text for an id that is there already"), (158, "x"), (159, "Ünïcödé – “quotes” 漢字 " * 5)]
    return out


ROWS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([("c", i, "l", t, 1, 2, 3, 4) for i, t in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, want):
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def plain_fingerprint(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_labels(values, distance):
    values, label = sorted(set(values)), {}
    for v in values:
        if v not in label:
            label[v], todo = v, [v]
            while todo:
                a = todo.pop()
                for b in values:
                    if b not in label and (a ^ b).bit_count() <= distance:
                        label[b] = v
                        todo.append(b)
    return label


def test_simhash(spark, docs, none):
    fps = [(i, plain_fingerprint(t, 4)) for i, t in ROWS]
    label = plain_labels([f for _, f in fps], 4)
    least = {}
    for i, f in fps:
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    same(simhash.near_duplicates(docs).collect(), [(i, f"{f:016x}", least.get(label[f])) for i, f in fps])
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_components_of_dense_groups(spark):
    rng = random.Random(1)
    centres = [rng.getrandbits(64) for _ in range(4)]
    values = {c for c in centres}
    for c in centres:
        for _ in range(120):
            x = c
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    got = simhash.fingerprint_components(spark.createDataFrame([(signed(v),) for v in values], "fp long"), 4).collect()
    want = plain_labels(values, 4)
    groups = lambda pairs: {frozenset(g) for g in pairs.values()}
    mine, theirs = defaultdict(set), defaultdict(set)
    for r in got:
        mine[r.label].add(r.fp % 2**64)
    for v, lab in want.items():
        theirs[lab].add(v)
    assert groups(mine) == groups(theirs)


def test_segments():
    for d in range(8):
        parts = simhash.segments(d)
        assert sum(n for _, n in parts) == 64 and d < 2 * len(parts)


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_one_of_each_group_stays(spark):
    rng = random.Random(12)
    base = [prose(rng, rng.randint(60, 400)) for _ in range(30)]
    rows = list(ROWS)
    for i, t in enumerate(base):
        rows.append((1000 + i, t))
        for j in range(rng.randint(0, 3)):
            w = t.split()
            for p in rng.sample(range(len(w)), max(1, len(w) // rng.choice([60, 100, 200]))):
                w[p] = "edited"
            rows.append((2000 + 10 * i + j, " ".join(w)))
    docs = spark.createDataFrame([("c", i, "l", t, 1, 2, 3, 4) for i, t in rows], SCHEMA).repartition(3)
    got = simhash.without_near_duplicates(docs)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in got.collect())
    assert not kept - Counter(rows)
    sets = [(i, t, shingles(t)) for i, t in rows]
    stay = [s for i, t, s in sets if kept[i, t]]
    for i, t, s in sets:  # what went is like something, if not all of it like what stays
        if not kept[i, t]:
            assert sum(jaccard(s, o) >= 0.7 for _, _, o in sets) > 1
    assert max(kept.values()) == 1 and len({t for _, t in kept}) == len(kept)
    twins = [(a, b) for a in range(len(sets)) for b in range(a) if jaccard(sets[a][2], sets[b][2]) >= 0.85]
    missed = [1 for a, b in twins if kept[sets[a][:2]] and kept[sets[b][:2]] and sets[a][:2] != sets[b][:2]]
    assert len(twins) > 50 and len(missed) <= 0.1 * len(twins) and len(stay) > 60


def plain_lines(rows, min_chars=20, min_docs=3):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add((i, t or ""))
    keeper = {k: max((i for i, _ in h if i is not None), default=None) for k, h in holders.items() if len(h) >= min_docs}
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if key(x) not in keeper or keeper[key(x)] == i]
        yield i, len(all_), len(all_) - len(kept), "\n".join(kept)


def test_lines(spark, docs, none):
    got = lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept").collect()
    same(got, plain_lines(ROWS))
    assert sum(r.n_dropped for r in got) > 5
    assert lines.dedup_lines(none).count() == 0
    kept = lines.without_repeated_lines(docs)
    assert kept.columns == docs.columns
    same([(r.doc_id, r.text or "") for r in kept.collect()], [(i, k) for i, _, _, k in plain_lines(ROWS)])


def test_line_runs_are_runs(spark):
    rows = [(i, "\n".join(f"a line that is repeated {j % 7} times" for j in range(30)) + f"\nown {i}") for i in range(4)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: [(x.start, x.length) for x in r.dropped or []] for r in got} == {0: [(0, 30)], 1: [(0, 30)], 2: [(0, 30)], 3: []}


def test_sharding(spark, docs, none):
    got = sharding.shards(docs, 7)
    rows = got.collect()
    same([(r.doc_id, r.size, r.text_crc32) for r in rows], [(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ROWS])
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    again = sharding.shards(docs.repartition(5), 7).collect()
    place = lambda rs: sorted((r.k1, r.k2, r.shard, r.slot) for r in rs)
    assert place(rows) == place(again)
    assert sharding.shards(none, 7).count() == 0


@pytest.mark.parametrize("total", [1, 2, 3, 7, 100, 4096, 70000])
def test_feistel_is_a_permutation(spark, total):
    from pyspark.sql import functions as F

    rows = spark.range(total).select(sharding.permuted(F.col("id"), total, 7).alias("x"))
    assert rows.agg(F.countDistinct("x"), F.min("x"), F.max("x")).first()[:] == (total, 0, total - 1)


def test_written_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, f"{tmp_path}/s", 5)
    back = spark.read.parquet(f"{tmp_path}/s")
    same([(r.doc_id, r.text) for r in back.collect()], ROWS)


@pytest.mark.parametrize("chunk", [1 << 19, 700])
def test_substrings(spark, docs, none, chunk, monkeypatch):
    got = {}
    if chunk == 700:  # texts of many chunks, run here without workers
        monkeypatch.setattr(substrings, "CHUNK", chunk)
        monkeypatch.setattr(substrings, "_TABLES", [])
        data = ("".join(random.Random(2).choice("abcdefgh ") for _ in range(5000))).encode()
        seen = np.concatenate([s for s, *_ in substrings.suffixes(np.frombuffer(data, np.uint8), 400, 200)]), np.concatenate([n for _, n, *_ in substrings.suffixes(np.frombuffer(data, np.uint8), 400, 200)])
        covered = np.concatenate([np.arange(s, s + n) for s, n in zip(*seen)])
        assert (np.sort(covered) == np.arange(5000 - 399)).all()
        return
    seen = Counter()
    for _, t in ROWS:
        b = (t or "").encode()
        seen.update(b[p : p + 400] for p in range(len(b) - 399))
    want = []
    for i, t in ROWS:
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                mark[p : p + 400] = b"\1" * 400
        runs = len(re.findall(rb"\x01+", bytes(mark)))
        want.append((i, len(b), sum(mark), runs, bytes(c for c, m in zip(b, mark) if not m)))
    rows = substrings.dedup_substrings(docs).collect()
    got = [(r.doc_id, r.n_bytes, sum(x.z - x.a for x in r.spans), len(r.spans), bytes(r.kept)) for r in rows]
    same(got, want)
    assert sum(w[2] for w in want) > 5000
    split = [re.split(r"[\x20\x09-\x0d]+", (t or "").strip(" \t\n\x0b\f\r")) for _, t in ROWS]
    passages = Counter(tuple(w[p : p + 51]) for w in split for p in range(len(w) - 50))
    same([(r.doc_id, r.shares_passage) for r in rows], [(i, any(passages[tuple(w[p : p + 51])] > 1 for p in range(len(w) - 50))) for (i, _), w in zip(ROWS, split)])
    assert {r.shares_passage for r in rows} == {True, False}
    assert substrings.dedup_substrings(none).count() == 0


def test_substrings_in_three_batches_and_hot(spark, docs, monkeypatch):
    want = substrings.dedup_substrings(docs).collect()
    monkeypatch.setattr(substrings, "HOT", 2)
    got = substrings.dedup_substrings(docs, batches=4).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_bytes, str(r.spans), bytes(r.kept))
    assert sorted(map(key, got)) == sorted(map(key, want))


def items(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, n)) for i, n in enumerate([30, 40, 13, 8, 5, 3, 60])] + [(90, None), (None, "an item without an id has no part in it"), (91, "")]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def plain_overlap(text, rows):
    def tok(t):
        for m in " ‘’“”–—…":
            t = t.replace(m, " ")
        return re.findall(r"(?:[a-z0-9_]|[^\x00-\x7f])+", t.lower())

    doc, best = tok(text or ""), None
    for i, t in rows:
        if i is None or t is None or len(item := tok(t)) < decontam.LEAST_TOKENS:
            continue
        w = min(13, len(item))
        need = w if len(item) < 13 else 11
        for a in range(len(item) - w + 1):
            for p in range(len(doc) - w + 1):
                equal = sum(x == y for x, y in zip(item[a : a + w], doc[p : p + w]))
                if equal >= need and (best is None or (equal / w, -i) > (best[1] / best[2], -best[0])):
                    best = i, equal, w
    return best


def test_decontamination(spark, none):
    rows, bench = items(spark)
    rng = random.Random(4)
    out = []
    for i, (_, t) in enumerate(rows):
        w = (t or "").split()
        out.append((i, f"{prose(rng, 12)} {t} {prose(rng, 9)}"))
        out.append((20 + i, f"{prose(rng, 5)}, {' '.join(w[: len(w) // 2])}! {prose(rng, 5)}"))
        for k in (1, 2, 3, 4, 6):
            v = list(w)
            for j in rng.sample(range(len(v)), min(k, len(v))):
                v[j] = "other"
            out.append((100 * k + i, f"{prose(rng, 3)} {' '.join(v).upper()} {prose(rng, 3)}"))
    out += [(900, None), (901, ""), (902, prose(rng, 2000)), (903, rows[0][1] + " " + rows[1][1]), (903, rows[0][1]), (None, rows[2][1])]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in out], "doc_id long, text string, item_id int, n_equal string")
    got = decontam.contamination(docs, bench)
    want = [(i, plain_overlap(t, rows)) for i, t in out]
    same([(r.doc_id, (r.item_id, r.n_equal, r.n_window) if r.contaminated else None) for r in got.collect()], want)
    assert 20 < sum(w is not None for _, w in want) < len(out) - 5
    clean = decontam.without_contaminated(docs, bench)
    assert clean.columns == docs.columns
    same([(r.doc_id,) for r in clean.collect()], [(i,) for i, w in want if w is None])
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    rows, bench = items(spark)
    docs = spark.createDataFrame([(i, f"some words {t} and more") for i, t in rows if i is not None], "doc_id long, text string")
    want = sorted(map(tuple, decontam.contamination(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_TOKENS", 60)
    assert len(decontam._item_blocks(bench, "item_id", "text")) > 3
    assert sorted(map(tuple, decontam.contamination(docs, bench).collect())) == want


def test_masks_miss_nothing():
    from itertools import combinations

    for mask in decontam.MASKS:
        on = [i for i, c in enumerate(mask) if c == "1"]
        for wrong in combinations(range(13), 2):
            assert any(all(p + i not in wrong for i in on) for p in range(13 - len(mask) + 1))


def test_tokens_in_pieces(monkeypatch):
    rng = random.Random(6)
    text = prose(rng, 800) + " " + "z" * 300 + " " + prose(rng, 5)
    whole = decontam.tokens(text)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 128)
    pieces = decontam.tokens(text)
    at = text.split().index("z" * 300)  # a word longer than a block falls apart
    assert (whole[:at] == pieces[:at]).all() and (whole[-5:] == pieces[-5:]).all()


def test_packing(spark, docs, none):
    import public_tokenizers as pt
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(pt.path("byte_bpe_50k.json"))
    for length in (1024, 64):
        got = packing.pack(docs, length=length).collect()
        want = []
        for i, t in ROWS:
            ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            head = len(ids) % length if len(ids) > length else 0
            cuts = [0, *([head] if head else []), *range(head + length, len(ids), length)] if len(ids) > length else [0]
            for k, (a, z) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
                want.append((i, k, a, z - a, zlib.crc32(ids[a:z].tobytes())))
        same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], want)
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            ends = [0, *np.cumsum([n for _, n in sorted(b)])]
            assert [o for o, _ in sorted(b)] == ends[:-1] and ends[-1] <= length
        assert len(bins) <= 1.03 * sum(w[3] for w in want) / length + 1
    assert packing.pack(none).count() == 0


def test_tokenizer_equality():
    import public_tokenizers as pt
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(pt.path("byte_bpe_50k.json"))
    encode = packing.encoder()
    for t in [t or "" for _, t in ROWS] + ["<|endoftext|> a", "b<|endoftext|><|endoftext|>", "<|endoftext|", " \n\n  x", "I'll  we've\t ½²", "\U0001f600 zero​width", "a" * 3000]:
        assert list(encode(t)) == tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_local_search_empties_bins(seed):
    rng = random.Random(seed)
    histogram = Counter(rng.choice([rng.randint(1, 100), rng.randint(30, 60)]) for _ in range(400))
    first = packing.best_fit(histogram, 100)
    last = packing.local_search(first, 100)
    content = lambda bins: sum((Counter({s: p.count(s) * n for s in set(p)}) for p, n in bins.items()), Counter())
    assert content(first) == content(last) == histogram and max(map(sum, last)) <= 100
    square = lambda bins: sum(sum(p) ** 2 * n for p, n in bins.items())
    assert last.total() <= first.total() and square(last) >= square(first)
    big = {s: n * 10**9 for s, n in histogram.items()}
    assert packing.best_fit(big, 100).total() >= sum(s * n for s, n in big.items()) / 100


def test_local_search_beats_a_poor_packing():
    poor = Counter({(50,): 4, (60,): 2, (40,): 2, (30, 30): 1, (40, 1): 1})
    assert packing.local_search(poor, 100).total() < poor.total()


def test_quality(spark, docs, none):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(20, 200)), 1) for i in range(150)]
    rows += [(200 + i, " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in prose(rng, rng.randint(20, 200)).split()), 0) for i in range(60)]
    table = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows], "doc_id long, text string, label string, __score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (999, None), (0, 1)], "doc_id long, quality int")
    truth = {i: y for i, _, y in rows}
    got = quality.classify(table, labels).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    few = quality.classify(docs, labels.limit(0)).collect()
    assert len(few) == len(ROWS) and len({r.score for r in few}) == 1
    assert quality.classify(none, labels).count() == 0
    kept = quality.without_low_quality(table.drop("__score"), labels)
    assert kept.columns == ["doc_id", "text", "label"] and 140 <= kept.count() <= 160


def test_scores_come_from_texts_alone(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 30) + ("###" if i % 3 else ""), i % 3 == 0) for i in range(60)]
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows], "doc_id long, quality int")
    table = spark.createDataFrame([(i, t, "en", "a") for i, t, _ in rows], "doc_id long, text string, lang string, source string")
    model = quality.fit(table, labels)
    a = {r.doc.text: r.score for r in quality.score(table, model).collect()}
    moved = table.selectExpr("doc_id + 1000 as doc_id", "text", "'xx' as lang", "'other' as source")
    assert {r.doc.text: r.score for r in quality.score(moved, model).collect()} == a


def test_gam_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0)).astype(float)
    model = quality.Gam().fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.85 and model.pairs[0][:2] == (0, 2)


def test_hash_of_kept_bytes_matches(spark, docs):
    out = substrings.dedup_substrings(docs)
    from pyspark.sql import functions as F

    for r in out.select("kept", F.sha2("kept", 256).alias("h")).limit(5).collect():
        assert r.h == hashlib.sha256(bytes(r.kept)).hexdigest()
