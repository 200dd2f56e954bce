"""Whole queries that SQL can't express, on whole tables, against plain Python versions that share only fitted models and fixed values with them."""

import bisect
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from stratalog.llm import quality, secrets

D = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}


def rows_of(name, *columns, d=D):
    return [tuple(r[c] for c in columns) for r in pq.read_table(f"{d}/{name}.parquet", columns=list(columns)).to_pylist()]


KINDS = {**{c: "upper" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "letter" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "digit" for c in "0123456789"}, **{c: "stop" for c in ".,;:"}, **{c: "bang" for c in "!?"}, **{c: "symbol" for c in "#$%&*@^~"}, "|": "pipe", **{c: "bracket" for c in "<>{}[]()/\\=_+`\""}, **{c: "space" for c in " \t\r\x0b\x0c"}, "\n": "newline"}
ORDER = ["upper", "letter", "digit", "stop", "bang", "symbol", "pipe", "bracket", "space", "newline", "other"]


def plain_quality_features(text):
    data = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return [0.0] * 30
    kinds = [KINDS.get(chr(b), "other") for b in data]
    n, nw, lines = len(data), len(words), data.split(b"\n")
    chunks = [kinds[a : a + 512] for a in range(0, n, 512)]
    if len(chunks) > 1 and len(chunks[-1]) < 256:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    shares = lambda *of: [sum(k in of for k in c) / len(c) for c in chunks]
    before = lambda kind, *after: sum(a == kind and b in after for a, b in zip(kinds, kinds[1:]))
    upper_pairs = sum(len(m) // 2 for m in re.findall("U+", "".join("U" if k == "upper" else "." for k in kinds)))
    pipes = len(re.findall(r" \| ", "".join(" " if k == "space" else "|" if k == "pipe" else "x" for k in kinds)))
    count = Counter(kinds)
    return [
        math.log1p(n), math.log1p(nw), (n - count["space"] - count["newline"]) / nw, *(count[k] / n for k in ORDER), len(set(words)) / nw, math.log1p(len(set(words))) / math.log1p(nw),
        sum(w in quality.COMMON for w in words) / nw, 1 - len(set(lines)) / len(lines), math.log1p(n / len(lines)), sum(bool(x) and x[-1:] not in (b".", b"!", b"?", b":", b";", b'"', b"'") for x in lines) / len(lines),
        before("symbol", "space", "newline") / nw, before("bang", "space", "newline") / nw, pipes / nw, upper_pairs / n, len(zlib.compress(data, 1)) / n,
        max(shares("symbol")), max(shares("upper")), max(shares("pipe")), max(shares("bang")), min(shares("letter", "other")),
    ]


def plain_score(model, x):
    """Tables looked up one by one."""
    total = model.base
    for j, table in enumerate(model.tables):
        total += table[bisect.bisect_left(list(model.edges[j]), x[j])]
    for i, j, table in model.pairs:
        total += table[bisect.bisect_left(list(model.wide[i]), x[i])][bisect.bisect_left(list(model.wide[j]), x[j])]
    return 1 / (1 + math.exp(-total))


@pytest.fixture(scope="module")
def model(spark):
    return quality.fit(spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet"))


def test_quality_query(spark, model):
    got = {r.doc_id: r for r in quality.op3_quality(spark, D).collect()}
    docs = rows_of("documents", "doc_id", "text")
    assert len(got) == len(docs) and model.pairs
    for i, t in docs:
        x = plain_quality_features(t or "")
        assert x == pytest.approx(quality.features(t or ""), abs=1e-12)
        want = plain_score(model, x)
        assert got[i].score == pytest.approx(want, abs=1e-9)
        assert got[i].predicted == (want >= 0.3) and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_quality_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    truth = dict(rows_of("labels", "doc_id", "quality", d=d))
    held = [r for r in quality.op3_quality(spark, d).collect() if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.95


def plain_candidates(text):
    """(nth, start, candidate, text before, text after), by a walk over the letters."""
    letters = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
    at = n = 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in letters:
            end += 1
        stop = end
        while stop < len(text) and text[stop] == "=" and stop < end + 2:
            stop += 1
        if end - at >= 20 and not (stop < len(text) and (text[stop] in letters or text[stop] == "=")):
            yield n, at, text[at:stop], text[:at], text[stop:]
            n += 1
        at = max(end, at + 1)


def plain_secret_features(cand, before, after):
    kind = lambda c: "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-"
    kinds = "".join(map(kind, cand))
    runs, n = 1 + sum(a != b for a, b in zip(kinds, kinds[1:])), len(cand)
    left, low = 0, cand.lower()
    words = sorted(secrets.DICTIONARY, key=len, reverse=True)
    at = 0
    while at < n:
        size = next((len(w) for w in words if low.startswith(w, at)), 0)
        left += not size
        at += size or 1
    letters = re.split("[^A-Za-z]+", cand)
    hit = lambda p, s: float(re.search(p, s, re.ASCII) is not None)
    whole = before[-1:] + cand
    path = whole[0] in "./:~" or hit(r"^.?[A-Za-z0-9_-]{1,24}/[A-Za-z0-9_/-]+$", whole) or hit(r"(://|\w/|\\)\S*$", before)
    lower_hex, upper_hex = set("0123456789abcdef"), set("0123456789ABCDEF")
    return [
        n, runs, runs / n, kinds.count("0") / n, kinds.count("A") / n, 1 - kinds.count("-") / n, set(cand) <= lower_hex or set(cand) <= upper_hex, len(set(cand)) / min(n, 64), (n - left) / n, max(map(len, letters)),
        path, hit("[=:]\\s*[\"'`]?$", before), before[-1:] in tuple("\"'`") and after[:1] in tuple("\"'`"), hit(secrets.SECRET_WORDS + r"\W{0,6}$", before), hit(secrets.DIGEST_WORDS + r"\W{0,6}$", before),
        hit(secrets.DUMMY_WORDS, before + after), hit(secrets.DUMMY_WORDS, cand) or hit(r"(.)\1{5}|0123456789|abcdefgh", cand),
    ]


def test_secret_scan(spark):
    """On sf0.01's documents and on labelled findings: every candidate, its features and its score."""
    trees = secrets.train(spark)
    docs = rows_of("documents", "doc_id", "text", d="/root/testdata/sf0.01")
    made = [(10**6 + i, t) for i, (t, _) in enumerate(secrets.labelled_findings(400, seed=5))]
    long = "z" * 70_000 + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + "a" * 19 + " " + "b" * 20 + "=== " + "c" * 20 + "=="
    rows = [*docs, *made, (2 * 10**6, long)]
    want = {}
    for i, t in rows:
        for nth, start, cand, before, after in plain_candidates(t or ""):
            x = plain_secret_features(cand, before[-secrets.BEFORE :], after[: secrets.AFTER])
            want[i, nth] = (start, cand, round(float(np.mean([secrets.predict(tree, [float(v) for v in x]) for tree in trees])), 6))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.nth): (r.start, r.finding, r.score) for r in secrets.scan(df).collect()}
    assert got.keys() == want.keys() and len(want) > 300
    for k, (start, cand, score) in want.items():
        assert got[k][:2] == (start, cand) and got[k][2] == pytest.approx(score, abs=2e-6)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_secrets_planted_in_documents(spark, sf):
    d = f"/root/testdata/{sf}"
    planted = {(i, m.start(1)) for i, t in rows_of("documents", "doc_id", "text", d=d) for m in re.finditer(r'token = "([0-9a-f]{40})"', t or "", re.IGNORECASE)}
    got = {(r.doc_id, r.start) for r in secrets.op8_secret_scan(spark, d).where("is_secret").collect()}
    assert planted and got == planted


def plain_kept_lines(docs):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate(LOWER)
    holders = defaultdict(set)
    for i, t in docs:
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    keeper = {k: max(h) for k, h in holders.items() if len(h) >= 3}
    return [(i, "\n".join(x for x in t.split("\n") if keeper.get(key(x), i) == i)) for i, t in docs]


def plain_first_of_groups(docs):
    sets, up = [], list(range(len(docs)))
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(docs)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for a, (i, _) in enumerate(docs):
        least[root(a)] = min(i, least.get(root(a), i))
    return [(i, t) for a, (i, t) in enumerate(docs) if least[root(a)] == i]


def plain_clean(docs, items):
    """Documents in which no 13 tokens in a row of an item stand in place with 11 of them equal; items of 5 to 12 stand whole."""
    number = {}

    def tok(t):
        for m in " ‘’“”–—…":
            t = t.replace(m, " ")
        return np.array([number.setdefault(x, len(number)) for x in re.findall(r"(?:[a-z0-9_]|[^\x00-\x7f])+", t.lower())], np.int64)

    own = [tok(t) for _, t in items if t]
    for i, t in docs:
        doc, hit = tok(t), False
        for item in own:
            w = min(13, len(item))
            if len(item) < 5 or len(doc) < w:
                continue
            at = len(doc) - w + 1
            for a in range(len(item) - w + 1):
                same = sum((doc[k : k + at] == item[a + k]).astype(np.int8) for k in range(w))
                hit |= int(same.max()) >= (11 if w == 13 else w)
        if not hit:
            yield i, t


def test_whole_pipeline(spark, model):
    import public_tokenizers as pt
    from tokenizers import Tokenizer

    import corpus_pipeline as cp

    docs = [(i, t or "") for i, t in rows_of("documents", "doc_id", "text")]
    good = [(i, t) for i, t in docs if plain_score(model, plain_quality_features(t)) >= 0.3]
    left = plain_first_of_groups(plain_kept_lines(good))
    clean = list(plain_clean(left, rows_of("benchmark", "item_id", "text")))
    assert len(docs) > len(good) > len(left) > len(clean) > 100
    tok, want, sizes = Tokenizer.from_file(pt.path("byte_bpe_50k.json")), set(), []
    for i, t in clean:
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids), 1024), len(ids)]
        for k, (a, z) in enumerate(zip(cuts, cuts[1:])):
            want.add((i, k, a, z - a, zlib.crc32(ids[a:z].tobytes())))
            sizes.append(z - a)
    got = cp.run(spark, D).collect()
    assert len(got) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        ends = np.cumsum([n for _, n in sorted(b)])
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 1024
    plain = []  # first fit of falling sizes
    for n in sorted(sizes, reverse=True):
        spot = next((j for j, used in enumerate(plain) if used + n <= 1024), None)
        if spot is None:
            plain.append(n)
        else:
            plain[spot] += n
    assert -(-sum(sizes) // 1024) <= len(bins) <= len(plain)
