"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import base64
import bz2
import collections
import gzip
import hashlib
import lzma
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from quillspan.llm import bpe, common, factorisation, line_dedup, order_minhash, packing, phrases, pivots, quality_rules, secrets, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, ids string, row string, score string, host_failed string"


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n)]


def corpus():
    base, other = words(180, 1), words(130, 2)
    passage = words(60, 3)
    near = list(base)
    near[90] = "changed"
    texts = [" ".join(base), " ".join(near), " ".join(base), None, "", "  \n\t ", " ".join(other + passage), " ".join(words(40, 4) + passage + words(30, 5)), "one two", "one two", "x" * 5000, "\n".join([" ".join(words(12, 6))] * 3), " ".join(words(12, 6)[:-1] + ["z"]), "naïve <|endoftext|>   \x1c ok 𝔘"]
    rows = [(i + 1, t, "en", "h" if i % 3 else None, None, "c", "c", "c", "c") for i, t in enumerate(texts)]
    return rows + [rows[0], (None, "a null id with words", None, "h", None, "c", "c", "c", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def both(values):
    return sorted(values, key=str)


def test_bpe(docs, none):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc, t, *_ in corpus():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert both(tuple(r) for r in bpe.digests(docs).collect()) == both(want)
    assert bpe.digests(none).count() == 0
    there_and_back = bpe.decode(bpe.encode(docs.drop("ids"))).select("text", "decoded").collect()
    assert all(r.decoded == (r.text or "") for r in there_and_back)


def test_long_words_take_the_same_merges():
    own = bpe.codec(bpe.vocabulary_path())
    for w in (b"hello" * 40, b"=" * 700, "ééé".encode() * 60):
        assert bpe._merge(w, own.ranks) == bpe._merge_long(w, own.ranks)


def test_packing(docs, none):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs).collect()
    by_sequence = collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    want = []
    for doc, t, *_ in corpus():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        start, end, k = 0, (len(ids) - 1) % 1024 + 1, 0
        while start < len(ids):
            want.append((doc, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
            start, end, k = end, end + 1024, k + 1
    assert both((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == both(want)
    assert packing.pack(none).count() == 0


def test_repeated_plan_is_the_plan_bin_by_bin():
    r = random.Random(0)
    for _ in range(20):
        counts = [0] * 33
        for _ in range(r.randint(1, 200)):
            counts[r.randint(1, 32)] += 1
        used = [0] * 33
        for own, repeats in packing.plan(counts, 32):
            assert sum(own) <= 32
            for n in own:
                used[n] += repeats
        assert used == counts


def test_two_replace_the_smallest():
    counts = [0] * 11
    counts[7] = counts[2] = 1  # greedy: 7, 2, gap 1
    counts[1] = 0
    assert packing._two_that_fit([1, 2], [0, 2, 2] + [0] * 8, 2, 3) == (2, 1)


def test_quality_rules(docs, none, spark):
    got = {(r.doc_id, r.n_words, r.n_repeat_words, r.n_dup_lines, r.base_failed) for r in quality_rules.judge(docs, ["doc_id"]).collect()}
    want = set()
    for doc, t, *_ in corpus():
        w = (t or "").encode().split()
        tri = collections.Counter(zip(w, w[1:], w[2:]))
        hit = {p for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for x in (t or "").split("\n"):
            dup += x in seen and bool(x.encode().split())
            seen.add(x)
        want.add((doc, len(w), len(hit), dup, len(w) < 50 or 100 * len(hit) > 50 * len(w)))
    assert got == want
    assert quality_rules.judge(none, ["doc_id"]).count() == 0
    bad = [(i, "w " * 5, None, "bad", None, "", "", "", "") for i in range(300)] + [(1000 + i, " ".join(words(60, i)), None, "good", None, "", "", "", "") for i in range(50)] + [(2000, " ".join(words(60, 9)), None, "bad", None, "", "", "", "")]
    kept = {r.doc_id for r in quality_rules.judge(spark.createDataFrame(bad, DOC), ["doc_id"]).where("kept").collect()}
    assert kept == {1000 + i for i in range(50)}


def test_secrets(docs, none):
    key = "AKIA" + "ABCD1234" * 2
    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    for text, kinds in {
        f"x {key} y": ["access"],
        "Password = 'hunter22'": ["assign"],
        "token: abc": [],
        "0123456789abcdef01234567": ["hex"],
        "see " + b64(f"key {key} end"): ["access"],
        "see " + b64(b64("my secret=abcdef99")): ["assign"],
        "see " + b64(zlib.compress(f"deep {key}".encode())): ["access"],
        "".join(f"%{c:02X}" for c in f"{key}".encode()): ["access"],
        "".join(f"\\u{ord(c):04x}" for c in f"{key} "): ["access"],
        "%2570assword=%61bcdef1": ["assign"],
    }.items():
        base, found = secrets.scan_text(text)
        assert [secrets.KINDS[k] for _, k, _ in found] == kinds, text
        assert set(base) <= set(found) and all(0 <= s < e <= len(text) for s, _, e in found)
    s, _, e = secrets.scan_text("ab %41KIAABCD1234ABCD1234 cd")[1][0]
    assert (s, e) == (3, 25)
    assert secrets.scan(docs).count() == len(corpus()) and secrets.scan(none).count() == 0
    assert "hunter22" not in secrets.redact(docs.sparkSession.createDataFrame([("a password=hunter22",)], "text string")).first().text


def test_secrets_in_url_safe_runs():
    r = random.Random(1)
    key = "AKIA" + "ABCD1234" * 2
    for _ in range(100):
        text = "".join(r.choice("ÿþ¿ñ>?abcdefgh ") for _ in range(200)) + f" password=hunter2222 {key}"
        for raw, kinds in ((text.encode(), {0, 1}), (zlib.compress(text.encode()), {0, 1})):
            run = base64.urlsafe_b64encode(raw).decode()
            assert {k for _, k, _ in secrets.scan_text(f"see {run} end")[1]} == kinds
            assert (4, 1, 4 + len(run)) in secrets.scan_text(f"see {run} end")[1]
    mixed = base64.b64encode(f"<<<???>>> {key}".encode()).decode()
    assert "/" in mixed or "+" in mixed
    assert {k for _, k, _ in secrets.scan_text(f"a_{mixed}")[1]} == {1}


def test_secrets_in_wrapped_and_glued_runs():
    r = random.Random(3)
    key = "AKIA" + "ABCD1234" * 2
    text = "".join(r.choice("abcdé über ") for _ in range(333)) + f" secret=hunter2222 {key} " + "".join(r.choice("xyzß ") for _ in range(200))
    for raw in (text.encode(), zlib.compress(text.encode()), bz2.compress(text.encode())):
        run = base64.b64encode(raw).decode()
        for width, gap in ((76, "\n"), (64, "\r\n"), (61, "\n  ")):
            block = gap.join(run[i : i + width] for i in range(0, len(run), width))
            for head, tail in (("", ""), ("see ", " end"), ("-----BEGIN CERTIFICATE-----\n", "\n-----END CERTIFICATE-----")):
                found = secrets.scan_text(head + block + tail)[1]
                assert {k for _, k, _ in found} == {0, 1}, (width, head)
                if head != "-----BEGIN CERTIFICATE-----\n":
                    assert {(s, e) for s, _, e in found} == {(len(head), len(head) + len(block))}
        for head in ("/data/", "/d/", "word", "a/b/c/some_directory/", "x-"):
            assert {k for _, k, _ in secrets.scan_text(f"{head}{run} end")[1]} == {0, 1}, head
    assert secrets.scan_text("internationalization\nand understanding\n" * 9)[1] == []


def test_secrets_in_whole_compressed_layers(monkeypatch):
    key = "AKIA" + "ABCD1234" * 2
    b64 = lambda x: base64.b64encode(x).decode()
    kinds = lambda x: {k for _, k, _ in secrets.scan_text(f"see {b64(x)} end")[1]}
    filler = ("é" * 31 + " ").encode()
    late = b"x" + filler * ((65 << 20) // len(filler)) + key.encode()
    assert kinds(zlib.compress(late)) == kinds(bz2.compress(late)) == {1}
    assert kinds(lzma.compress(key.encode(), preset=9)) == {1}
    for pack in (gzip.compress, bz2.compress, lzma.compress, zlib.compress):
        assert kinds(pack(b"nothing ") + pack(f"{key[:9]}".encode()) + pack(f"{key[9:]} ".encode()) + pack(b"token=abcdef")) == {0, 1}
    deep = key.encode()
    for _ in range(100):
        deep = zlib.compress(deep, 0)
    assert kinds(deep) == {1}
    assert kinds(zlib.compress(gzip.compress(b"token=abcdef ") + f" and {key}".encode())) == {0, 1}
    monkeypatch.setattr(secrets, "PIECE", 100)
    monkeypatch.setattr(secrets, "OVERLAP", 30)
    r = random.Random(4)
    for n in range(120):
        head = " ".join(words(20, n)) + "é" * r.randrange(9) + " "
        assert kinds(zlib.compress(f"{head} {key} {head}".encode())) == {1}
        assert kinds(bz2.compress(f"{head} token{' ' * n}= abcdef {head}".encode())) == {0}
        assert kinds(gzip.compress(f"{head} {b64(zlib.compress((head + key).encode()))} {head}".encode())) == {1}


def test_secrets_beside_bad_bytes():
    key = "AKIA" + "ABCD1234" * 2
    b64 = lambda x: base64.b64encode(x).decode()
    quoted = "".join(f"%{c:02x}" for c in key.encode())
    for bad in ("%FF", "%C3", "%ED%A0%80", "%E2%82", "%F5%80"):
        assert (len(bad), 1, len(bad) + 60) in secrets.scan_text(f"{bad}{quoted}{bad}")[1]
    escaped = "".join(f"\\u{ord(c):04x}" for c in key)
    for bad in ("\\ud800", "\\udc00", "&#x110000;"):
        assert (len(bad), 1, len(bad) + 120) in secrets.scan_text(f"{bad}{escaped}{bad}")[1]
    assert secrets.scan_text("".join(f"%{c:02X}" for c in "pässword é€𝔘 token=abcdé".encode()))[1] == []
    text = f"name=\u00fcber\0token=abcdef\0{key}\0"
    for raw in (text.encode(), text.encode("latin-1"), text.encode("utf-16"), text.encode("utf-16-be")):
        for pack in (bytes, zlib.compress, bz2.compress):
            assert {k for _, k, _ in secrets.scan_text(f"see {b64(pack(raw))} end")[1]} == {0, 1}, (raw, pack)


def test_phrases(docs, none, spark, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = both(tuple(r) for r in phrases.op7_phrases(spark, str(tmp_path)).collect())
    first = {}
    for doc, t, *_ in corpus():
        w = (t or "").encode().split()
        for i in range(len(w) - 49):
            if doc is not None:
                first[tuple(w[i : i + 50])] = min(first.get(tuple(w[i : i + 50]), doc), doc)
    want = []
    for doc, t, *_ in corpus():
        w = (t or "").encode().split()
        gone = {p for i in range(len(w) - 49) if doc is not None and first[tuple(w[i : i + 50])] < doc for p in range(i, i + 50)}
        kept = [x for p, x in enumerate(w) if p not in gone]
        want.append((doc, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    assert got == both(want)
    none.write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert phrases.op7_phrases(spark, f"{tmp_path}/empty").count() == 0


def test_line_dedup(docs, none):
    gone = {r.doc: r.lines for r in line_dedup.removals(docs).collect()}
    seen, want = [], {}
    for doc, t, *_ in sorted({r[:2]: r for r in corpus()}.values(), key=lambda r: line_dedup.NO_DOC if r[0] is None else r[0]):
        for k, x in enumerate((t or "").split("\n")):
            s = frozenset(x.encode().split())
            if s and any(5 * len(s & y) >= 4 * len(s | y) for y in seen):
                want.setdefault(doc, []).append(k)
            if s:
                seen.append(s)
    assert gone == want
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns and {3, 4, 5, 6} & {r.doc_id for r in out.collect()} == {4, 5, 6}
    assert line_dedup.dedup_lines(none).count() == 0


def test_order_minhash(docs, none):
    classes = {r.doc_id: r.class_id for r in order_minhash.near_documents(docs).collect()}
    assert classes[2] == classes[3] == 1 and classes[10] == 9 and classes[7] == 7 and classes[8] == 8 and classes[4] == 4
    out = order_minhash.dedup_documents(docs)
    assert out.columns == docs.columns
    assert both(r.doc_id for r in out.collect() if r.doc_id) == both([1, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14])
    assert order_minhash.near_documents(none).count() == 0


def test_alignment_is_the_common_subsequence():
    r = random.Random(3)
    for _ in range(300):
        a = [str(r.randint(0, 60)) for _ in range(r.randint(5, 60))]
        b = [x for x in a if r.random() > 0.03]
        if len(b) > 8 and r.random() < 0.3:
            b[2:4], b[6:8] = b[6:8], b[2:4]
        x, y = order_minhash.labelled([w.encode() for w in a]), order_minhash.labelled([w.encode() for w in b])
        row = [0] * (len(y) + 1)
        for u in x.tolist():
            new = [0]
            for j, v in enumerate(y.tolist()):
                new.append(row[j] + 1 if u == v else max(row[j + 1], new[j]))
            row = new
        assert order_minhash.similar(x, y) == (bool(len(x) and len(y)) and 5 * row[-1] >= 4 * (len(x) + len(y) - row[-1]))


def test_sketch_recall():
    """Candidates among pairs at similarity 0.8 to 0.85."""
    r, met, n = random.Random(5), 0, 0
    while n < 200:
        a = [str(r.random()) for _ in range(300)]
        b = list(a)
        for p in r.sample(range(300), 6):
            b[p] = "x"
        x, y = (order_minhash.labelled([w.encode() for w in t]) for t in (a, b))
        if not order_minhash.similar(x, y):
            continue
        n += 1
        met += (order_minhash.sketch(x) == order_minhash.sketch(y)).sum() >= order_minhash.AGREE
    assert met == n


def test_sketch_recall_of_short_texts():
    """The stated chances of a miss, 0.0035 for 4 of 5 k-mers and 0.00045 for 8 of 10, and what is missed of 8,000 pairs each."""
    r = random.Random(6)
    for shared, union, stated in ((4, 5, 0.0035), (8, 10, 0.00045)):
        p = math.comb(shared, order_minhash.TAKEN) / math.comb(union, order_minhash.TAKEN)
        chance = sum(math.comb(order_minhash.SKETCHES, k) * p**k * (1 - p) ** (order_minhash.SKETCHES - k) for k in range(order_minhash.AGREE))
        assert abs(chance - stated) < 0.05 * stated
        missed = 0
        for _ in range(8000):
            a = [str(r.random()).encode() for _ in range(union + order_minhash.GRAM - 1)]
            x, y = order_minhash.labelled(a), order_minhash.labelled(a[: shared - union])
            assert (len(x), len(y)) == (union, shared) and order_minhash.similar(x, y)
            missed += (order_minhash.sketch(x) == order_minhash.sketch(y)).sum() < order_minhash.AGREE
        assert missed <= 8000 * stated + 4 * (8000 * stated) ** 0.5 + 1
    p = lambda n, k: math.comb(k, order_minhash.TAKEN) / math.comb(n, order_minhash.TAKEN)
    assert min(p(n, -(-4 * n // 5)) for n in range(5, 2000)) == p(5, 4)


def test_warc(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\nabcdefghij\r\n\r\n"
    rows = [(1, "http://a", "x"), (2, None, "x"), (3, "u\r\nv", None), (4, "u", ""), (5, "u", fake), (6, "u", fake + fake + "z"), (7, "u", "é€ WARC/1.1\r\n"), (8, "u", "WARC/1.1\r\n"), (9, "q", fake), (9, "q", fake)]
    spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, digest string").write.parquet(f"{tmp_path}/pages.parquet")
    got = both(tuple(r) for r in warc.op6_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    largest = {}
    for i, _, h in rows:
        largest[digest(h)] = max(i, largest.get(digest(h), i))
    want, shown = [], set()
    for i, _, h in rows:
        d = digest(h)
        own = largest[d] == i and d not in shown
        if own:
            shown.add(d)
        want.append((i, len((h or "").encode()), d, "response" if own else "revisit", None if own else largest[d]))
    assert got == both(want)


def test_classifier(spark, docs, none):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    rows = factorisation.op1_factorisation(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.97
    labels = docs.select("doc_id", F.lit(None).cast("int").alias("quality"))
    machine = factorisation.fit(docs, labels)
    assert {r.score for r in factorisation.score(docs, machine, ["doc_id"]).collect()} == {0.5}
    assert factorisation.score(none, machine, ["doc_id"]).count() == 0


def test_pairs_by_sum_of_squares():
    r = np.random.default_rng(1)
    m = factorisation.Machine(0.1, r.normal(size=factorisation.FEATURES), r.normal(size=(factorisation.FEATURES, 3)))
    i, x = np.array([3, 70, 900]), np.array([0.5, 1.5, -1.0])
    pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * x[a] * x[b] for a in range(3) for b in range(a))
    assert abs(m.raw(i, x) - (0.1 + m.weights[i] @ x + pairs)) < 1e-9


def test_pivots(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 64))
    x[100:130] = x[100] + 0.15 * r.normal(size=(30, 64))
    u = x[200] / np.linalg.norm(x[200])
    for k in range(201, 301):  # pairs right above the threshold
        v = r.normal(size=64)
        v -= v @ u * u
        x[k] = 0.952 * u + np.sqrt(1 - 0.952**2) * v / np.linalg.norm(v)
    x[400] = x[401]
    rows = [(i, [float(y) for y in v.astype(np.float32)], 0) for i, v in enumerate(x)]
    rows += [(900, None, 0), (901, [0.0] * 64, 0), (902, [float("nan")] * 64, 0), (903, [None] * 64, 0), (904, rows[5][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {g.vec_id: g for g in pivots.near_vectors(df).collect()}
    small = {g.vec_id: (g.n_links, g.component_id) for g in pivots.near_vectors(df, block=16).collect()}
    assert small == {k: (g.n_links, g.component_id) for k, g in got.items()}  # blocks change nothing
    y = np.array([v for i, v, _ in rows[:600]] + [rows[5][1]], np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    s = y @ y.T >= 0.95
    np.fill_diagonal(s, False)
    links = dict(zip([*range(600), 904], s.sum(1)))
    assert sum(got[k].n_links for k in links) >= 0.9 * sum(links.values())
    assert all(got[k].n_links <= n for k, n in links.items())
    assert got[904].component_id == 5 and not got[904].kept and got[900].kept and got[901].n_links == 0
    assert pivots.near_vectors(df.limit(0)).count() == 0


def test_pivots_in_a_large_group(spark, tmp_path):
    """A third of the vectors are near copies: around one centre, the pairs close to the threshold."""
    r = np.random.default_rng(5)
    n, group = 24000, 8000
    x = r.normal(size=(n, 64))
    x[:group] = x[0] / np.linalg.norm(x[0]) + np.sqrt((1 / 0.955 - 1) / 64) * r.normal(size=(group, 64))
    x = x.astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list(x), pa.list_(pa.float32()))}), f"{tmp_path}/v.parquet")
    got = {g.vec_id: g for g in pivots.near_vectors(spark.read.parquet(f"{tmp_path}/v.parquet")).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = np.concatenate([(y[i : i + 2000] @ y.T >= 0.95).sum(1) - 1 for i in range(0, n, 2000)])
    links = np.array([got[k].n_links for k in range(n)])
    assert (links <= want).all() and links.sum() >= 0.999 * want.sum() > 1e7
    root = min(np.flatnonzero(want[:group]))
    assert all(got[k].component_id == root for k in range(group) if want[k] > 1)


CLASH = "doc_id long, text string, lang string, source string, n_chars long, _doc string, _lines string, _row string, _host string, _text string, kept string, n_words string, base_failed string, lines string, doc string, row string, class string, score string, spans string, sequence_id string"


def test_columns_of_any_name_stay(spark):
    """Through every operator that returns its input's columns, and every stage of the pipeline, in the pipeline's order."""
    import corpus_pipeline

    texts = [" ".join(words(60, 30 + i)) for i in range(4)] + [" ".join(words(60, 30)), None, ""]
    rows = [(i, t, "en", "h", None, *(f"{n}{i}" for n in range(15))) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, CLASH)
    extra = {r[0]: r[5:] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == [x.split()[0] for x in CLASH.split(", ")], name
        got = docs.collect()
        assert {r.doc_id for r in got} <= set(range(5)) and all(tuple(r)[5:] == extra[r.doc_id] for r in got), name
    assert len(got) == 4
    assert packing.pack(docs).count() == 4
    assert set(factorisation.score(docs, factorisation.fit(docs, docs.selectExpr("doc_id", "1 as quality")), docs.columns).columns) >= {"_text", "score", "predicted"}
    assert secrets.scan(docs).count() == 4 and bpe.digests(docs).count() == 4


def test_pipeline_by_hand(spark, tmp_path):
    """The whole run against what each stage has to do, worked out plainly."""
    import corpus_pipeline

    base = [words(14, 50 + i) for i in range(9)]
    text = lambda *ls: "\n".join(" ".join(x) for x in ls)
    near = [list(x) for x in base[3:7]]
    near[1][3] = "edited"
    rows = [
        (1, text(*base[:3], *base[7:8])), (2, "too short"), (3, text(*base[3:7])), (4, text(*near)),
        (5, text(base[0], *[words(14, 70 + i) for i in range(4)]) + " password=hunter2222"), (6, None), (7, "w " * 90), (8, text(*[words(14, 80 + i) for i in range(5)])),
    ]
    spark.createDataFrame([(i, t, "en", f"h{i}", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    kept = {1: rows[0][1], 3: rows[2][1], 5: text(*[words(14, 70 + i) for i in range(4)]) + " [assign]", 8: rows[7][1]}
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in kept.items()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # lines of 4 that are near those of 3 go, and with them all its words
    assert {r.doc_id: r.length for r in got} == want
    assert sum(r.length for r in got) <= 1024 * len({r.sequence_id for r in got})


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_unlinked_texts_of_one_id_stay(spark):
    a, b = " ".join(words(60, 90)), " ".join(words(60, 91))
    docs = spark.createDataFrame([(5, a), (5, b), (6, a), (7, b + " more"), (None, a), (8, ""), (8, "")], "doc_id long, text string")
    out = sorted((r.doc_id, r.text) for r in order_minhash.dedup_documents(docs).collect())
    assert out == sorted([(5, a), (5, b), (8, "")])
    classes = {(r.doc_id, r.row): r["class"] for r in order_minhash.near_documents(docs).collect()}
    assert len(set(classes.values()) - {None}) == 2


def test_order_minhash_against_all_pairs(spark):
    """Classes of the smallest dataset's documents by comparing all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    kmers = [order_minhash.labelled(t.encode().split()) for _, t in rows]
    over = list(range(len(rows)))

    def top(x):
        while over[x] != x:
            x = over[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            equal = rows[i][1].split() == rows[j][1].split() and rows[i][1].split()
            if equal or order_minhash.similar(kmers[i], kmers[j]):
                a, b = top(i), top(j)
                over[max(a, b)] = min(a, b)
    want = {rows[i][0]: rows[top(i)][0] for i in range(len(rows))}
    assert {r.doc_id: r.class_id for r in order_minhash.near_documents(docs).collect()} == want
    assert len(set(want.values())) < len(want)


def test_lines_met_by_two_words_and_in_blocks(spark, monkeypatch):
    """With the bounds of hot words and blocks at a few sets, the same lines go as by comparing all pairs."""
    monkeypatch.setattr(line_dedup, "HOT", 2)
    monkeypatch.setattr(line_dedup, "GROUP", 3)
    monkeypatch.setattr(line_dedup, "HELD", 50)
    r = random.Random(8)
    pool = words(40, 7)
    rows = []
    for i in range(40):
        lines = []
        for _ in range(6):
            line = r.sample(pool, r.randint(3, 14))
            lines.append(line)
            if r.random() < 0.5:
                lines.append([x for x in line if r.random() > 0.1] + r.sample(pool, r.randint(0, 1)))
        rows.append((i, "\n".join(" ".join(x) for x in lines)))
    seen, want = [], {}
    for doc, t in rows:
        for k, x in enumerate(t.split("\n")):
            s = frozenset(x.split())
            if s and any(5 * len(s & y) >= 4 * len(s | y) for y in seen):
                want.setdefault(doc, []).append(k)
            if s:
                seen.append(s)
    got = {x.doc: x.lines for x in line_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and want


def test_vectors_of_all_dimensions(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.01]), (3, [1.0, 2.0]), *((10 + i, [float(i % 7), 1.0, 2.0, float(i)]) for i in range(20)), (50, [1.0, 2.0, 0.0, 0.0]), (51, [0.1]), (52, [0.2]), (53, [-0.3]), (54, [])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in (1, 2, 3, 50, 51, 52, 53, 54)] == [(2, 1), (2, 1), (2, 1), (0, 50), (1, 51), (1, 51), (0, 53), (0, 54)]


def test_classifier_contract(spark):
    """No label of a held-out row, and none at all, changes a score that others fixed; scores are of 0 to 1, predictions follow them."""
    import zlib as z

    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = factorisation.op1_factorisation(spark, sf).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (z.crc32(str(r.doc_id).encode()) % 3 == 1)
    turned = labels.withColumn("quality", F.when(factorisation.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = factorisation.score(docs, factorisation.fit(docs, turned), ["doc_id"]).collect()
    assert {r.doc_id: r.score for r in again} == {r.doc_id: r.score for r in rows}
    others = docs.withColumns({"lang": F.lit("x"), "source": F.lit("y"), "doc_id": F.col("doc_id")})
    assert {r.doc_id: r.score for r in factorisation.score(others, factorisation.fit(docs, labels), ["doc_id"]).collect()} == {r.doc_id: r.score for r in rows}


def best_two_fit(lengths, capacity):
    """Bin by bin, in plain steps: greedy from the longest, then the smallest goes for two that fill its place and the gap better."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        own, gap, rest = [], capacity, []
        for n in left:
            if n <= gap:
                own.append(n)
                gap -= n
            else:
                rest.append(n)
        left = rest
        if gap and own:
            room, best = own[-1] + gap, None
            for i in range(len(left)):
                for j in range(i + 1, len(left)):
                    two = left[i] + left[j]
                    if own[-1] < two <= room and (best is None or two > best[0]):
                        best = (two, i, j)
            if best:
                left.append(own.pop())
                own += [left[best[1]], left[best[2]]]
                for k in sorted(best[1:], reverse=True):
                    del left[k]
                left.sort(reverse=True)
        bins.append(own)
    return bins


def test_packing_is_as_good_as_bin_by_bin():
    r = random.Random(12)
    for _ in range(40):
        lengths = [r.randint(1, 32) for _ in range(r.randint(1, 120))]
        counts = [0] * 33
        for n in lengths:
            counts[n] += 1
        made = sum(k for _, k in packing.plan(counts, 32))
        bound = -(-sum(lengths) // 32)
        assert bound <= made == len(best_two_fit(lengths, 32))
    assert sum(k for _, k in packing.plan([0] * 3 + [4] + [0] * 2 + [4] + [0] * 3, 9)) == 4  # 3 and 6, four times


def test_secrets_base_against_plain_patterns():
    import re

    plain = (
        (re.compile(r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 6),
        (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
        (re.compile(r"[0-9a-f]+"), 0, 24),
    )
    r = random.Random(13)
    parts = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", ":", "=", " ", '"', "'", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "é", "\n", "hunter2", "deadbeef" * 3, "X", ".", "-"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        want = sorted((m.start(), k, m.end()) for k, (p, group, least) in enumerate(plain) for m in p.finditer(text) if len(m[group]) >= least)
        assert sorted(secrets.scan_text(text)[0]) == want, text


def test_spans_map_through_two_layers():
    r = random.Random(14)
    for _ in range(100):
        before, after = "".join(r.choice("ab é𝔘\n") for _ in range(r.randint(0, 20))), "".join(r.choice("xy ") for _ in range(r.randint(0, 20)))
        inner = base64.b64encode(f"some words and AKIA{'ABCD1234' * 2} behind".encode()).decode()
        run = base64.b64encode(f"outer text {inner} end".encode()).decode()
        found = secrets.scan_text(f"{before} {run} {after}")[1]
        assert (len(before) + 1, 1, len(before) + 1 + len(run)) in found


def test_warc_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op6_warc(spark, str(tmp_path)).count() == 0


def test_megabyte_texts(spark, tmp_path):
    """A text of over a megabyte, of one line and of many, through every operator on documents."""
    import corpus_pipeline

    long = " ".join(words(160_000, 15))
    many = "\n".join(" ".join(x) for x in zip(*[iter(words(150_000, 16))] * 10))
    assert len(long) > 1 << 19 and len(many) > 1 << 19
    docs = spark.createDataFrame([(1, long, "en", "h", None), (2, many, "en", "h", None), (3, long + " x", "en", "h", None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_words for r in quality_rules.judge(docs, ["doc_id"]).collect()} == {1: 160_000, 2: 150_000, 3: 160_001}
    assert {r.doc_id: r.class_id for r in order_minhash.near_documents(docs).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: r.n_removed for r in phrases.op7_phrases(spark, str(tmp_path)).collect()} == {1: 0, 2: 0, 3: 160_000}
    assert {r.doc for r in line_dedup.removals(docs).collect()} == {3}
    assert secrets.scan(docs).count() == 3 and packing.pack(docs).count() > 1000
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.n_tokens for r in bpe.digests(docs.where("doc_id < 2")).collect()} == {1: len(tok.encode(long, add_special_tokens=False).ids)}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {1, 2}


def test_located_stretches_against_all_windows():
    """Words whose hashes agree in the letters but not in the rest are told apart; stretches are those of windows that passages of smaller doc_ids have."""
    r = random.Random(17)
    for _ in range(30):
        pool = [np.uint64(r.randrange(40) | (r.randrange(2) << 16)) for _ in range(12)]
        base = np.array([r.choice(pool) for _ in range(300)], np.uint64)

        def edited(x, n):
            x = x.copy()
            for _ in range(n):
                x[r.randrange(len(x))] ^= np.uint64(1 << 16)
            return x

        shard = phrases._Shard()
        held = [(d, edited(base, r.randrange(4))[r.randrange(60) : r.randrange(150, 300)]) for d in range(5, 12)]
        for d, x in held:
            shard.add(d, x)
        doc, words_ = 9, edited(base, 3)
        earlier = {tuple(x[i : i + 50].tolist()) for d, x in held if d < doc for i in range(len(x) - 49)}
        want = {p for i in range(len(words_) - 49) if tuple(words_[i : i + 50].tolist()) in earlier for p in range(i, i + 50)}
        assert {p for a, b in shard.locate(doc, words_) for p in range(a, b)} == want


def test_components_of_few_edges_take_few_jobs(spark, monkeypatch):
    """A path of 200 nodes, which takes rounds many jobs to connect, a star, loops and null ends; beyond the bound, rounds give the same."""
    r = random.Random(40)
    path = r.sample(range(1, 10_000), 200)
    edges = [*zip(path, path[1:]), *((20_000, 20_000 + k) for k in range(1, 50)), (7, 7), (None, 5), (30_001, 30_000), (30_000, 30_001)]
    frame = common.stored(spark.createDataFrame(edges, "a long, b long"))
    want = {k: min(path) for k in path if k != min(path)} | {20_000 + k: 20_000 for k in range(1, 50)} | {30_001: 30_000}
    spark.sparkContext.setJobGroup("few edges", "")
    out = common.components(frame)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few edges"))
    spark.sparkContext.setJobGroup("other", "")
    assert sorted(out.collect()) == sorted(want.items())
    assert 0 < jobs <= 6
    for few in (0, 100):  # to the end by rounds, and the last of it in one task
        monkeypatch.setattr(common, "FEW_EDGES", few)
        assert sorted(common.components(frame).collect()) == sorted(want.items())
    assert common.components(frame.where("false")).count() == 0


def test_candidates_that_share_too_little_are_not_aligned(monkeypatch):
    """A bucket of texts that agree in sketches and are not alike: all links of all pairs, few alignments."""
    r, base = random.Random(41), words(80, 42)
    texts = []
    for _ in range(60):
        t = list(base)
        for k in r.sample(range(80), r.randint(0, 5)):
            t[k] = f"w{r.random()}"
        texts.append(" ".join(t))
    kmers = [order_minhash.labelled(t.encode().split()) for t in texts]
    sketches = [order_minhash.sketch(k) for k in kmers]
    key = sketches[0][0]
    met = [k for k in range(60) if sketches[k][0] == key]
    meet = lambda x, y: (same := sketches[x] == sketches[y]).sum() >= order_minhash.AGREE and same.argmax() == 0
    pairs = [(x, y) for x in met for y in met if x < y and meet(x, y)]
    over = list(range(60))
    for x, y in pairs:
        if order_minhash.similar(kmers[x], kmers[y]):
            over = [over[x] if o == over[y] else o for o in over]
    number = lambda values, kind: pa.array(values, kind)
    n = len(met)
    batch = pa.RecordBatch.from_arrays([number([int(key)] * n, pa.int64()), number([0] * n, pa.int32()), number([0] * n, pa.int32()), number([0] * n, pa.int32()), number(met, pa.int64()), number(met, pa.int64()), number(met, pa.int64()), number([sketches[k].tolist() for k in met], pa.list_(pa.int64())), number([texts[k] for k in met], pa.string())], ["key", "i", "j", "block", "doc", "first", "root", "sketch", "text"])
    aligned, similar = [], order_minhash.similar
    monkeypatch.setattr(order_minhash, "similar", lambda x, y: aligned.append(similar(x, y)) or aligned[-1])
    links = [(a, b) for out in order_minhash._rest([batch]) for a, b in zip(*(c.to_pylist() for c in out.columns))]
    found = list(range(60))
    for x, y in links:
        found = [found[x] if o == found[y] else o for o in found]
    classes = lambda over: sorted(sorted(k for k in met if over[k] == o) for o in {over[k] for k in met})
    assert classes(found) == classes(over) and len(classes(over)) > 3 and links
    assert len(aligned) <= len(links) + len(pairs) // 20


def test_parquet_is_read_by_few_rows(spark, docs):
    """Stored tables and the near-dedup plan that the caller runs hold few whole texts at once; a smaller setting stays."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "4096")
        with common.small_batches(spark, 10):
            assert spark.conf.get(name) == "512"
        assert spark.conf.get(name) == "4096"
        order_minhash.dedup_documents(docs)
        assert spark.conf.get(name) == "512"
        spark.conf.set(name, "100")
        with common.small_batches(spark, 10):
            assert spark.conf.get(name) == "100"
    finally:
        spark.conf.set(name, before)
