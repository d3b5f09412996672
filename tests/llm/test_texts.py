import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import decontamination, mixing, quality, secret_scan, token_file, url_filter

DOCS = "doc_id long, text string, _row string"
ITEMS = "item_id long, text string, hits string"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)


def judged_by_brute(docs, items):
    out = []
    for doc_id, text in docs:
        have, hit, found = words(text), set(), set()
        for item, passage in items:
            want = words(passage)
            k = min(13, len(want))
            windows = {tuple(want[i : i + k]) for i in range(len(want) - k + 1)} if want else set()
            for s in range(len(have) - k + 1):
                if tuple(have[s : s + k]) in windows:
                    hit |= set(range(s, s + k))
                    found.add(item)
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(have), len(hit), ids, len(hit) > 0 and 20 * len(hit) >= len(have)))
    return sorted(out, key=repr)


def contaminated():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(30)] + ["É", "straße", "x9"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 40)))) for i in range(12)] + [(50, None), (51, "..."), (52, "Only one-two"), (None, "no id here at all"), (3, "a second text of an id already there, of fifteen words in all or so it is")]
    docs = []
    for i in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(200))]
        passage = (rng.choice(items)[1] or "").split()
        cut = rng.randrange(len(passage) + 1)
        text[len(text) // 2 : len(text) // 2] = passage[cut // 3 :]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(text).upper() if i % 3 else " ".join(text)))
    return docs + [(90, None), (91, ""), (92, "?!"), (93, items[0][1]), (93, items[0][1]), (None, items[1][1]), (94, "word " * 30000 + items[2][1])], items


def test_decontamination(spark):
    docs, items = contaminated()
    left = spark.createDataFrame([(*d, "x") for d in docs], DOCS)
    right = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    got = decontamination.judged(left, right).collect()
    want = judged_by_brute(docs, items)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=repr) == want
    kept = decontamination.clean(left, right)
    assert kept.columns == left.columns
    assert kept.count() == sum(not w[-1] for w in want)
    assert decontamination.judged(left, right.limit(0)).where("contaminated").count() == 0
    assert decontamination.judged(left.limit(0), right).collect() == []


def test_decontamination_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    docs, items = contaminated()
    got = decontamination.judged(spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=repr) == judged_by_brute(docs, items)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "b x a y c b a", ""), (2, "a a a", ""), (3, "c z z z b a", ""), (4, None, "")], DOCS)
    items = spark.createDataFrame([(7, "A b c", "")], ITEMS)
    got = sorted((r.doc_id, r.start, r.end) for r in decontamination.proximity(docs, items, 6).collect())
    assert got == [(1, 4, 7), (3, 0, 6)]
    assert decontamination.proximity(docs, items, 5).count() == 1


URLS = [None, "", "x", "http://", "HTTP://A.ORG", "a://Ex.ORG/x?y://z", "http://example.org/en/1\n?x", "://b.com:80/fr/", "http://notcom/fr/1", "http://x.com/fr/1", "http://com/de/", "http://s.example.org/es/2#f", "http://a.org/x", "http://a.net/?p=1&q=2", "http://xorg/", "http://É.org/é"]


def ruled(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filter.RULES if (host == r[1].split("/")[0] or host.endswith("." + r[1].split("/")[0])) and path.startswith("/" + r[1].split("/", 1)[1])]
    return host, path, *(max(fits, key=lambda r: len(r[1]))[::-1] if fits else (None, None))


def test_url_rules(spark):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(None, URLS[9], "clash"), (9, URLS[9], "clash")]
    got = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()
    assert len(got) == len(rows)
    by_id = {r.page_id: r for r in got if r.page_id is not None}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = ruled(u)
        assert (by_id[i].host, by_id[i].path, by_id[i].rule) == (host, path, rule)
        assert by_id[i].verdict == (verdict or by_id[i].verdict) and by_id[i].verdict in ("allow", "block")
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_trees_learn_and_hold_out():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = url_filter.fit(x[:2000], y[:2000])
    assert ((model.scores(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.95
    found, plain = url_filter.held_out(x, y)
    assert found > 0.95 > plain
    assert url_filter.fit(x[:0], y[:0]).trees == ()
    assert (url_filter.fit(x, np.ones(3000)).scores(x) > 0).all()


def spans_by_brute(text):
    out = []
    keys = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    for m in re.finditer(rf"""({keys})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 12)
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [(secret_scan.KINDS[k], a, b) for a, k, b in sorted(out)]


def test_secrets(spark):
    rng = random.Random(9)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    b62 = secret_scan.ENCODINGS["base62"]
    texts = ["Token = '" + key(30, b62) + "'", "é API_KEY: " + key(12, b62) + " api-key: " + key(20, b62), "secret: token = abcdefghijkl", "ſecret=" + key(20, b62), "to\u212aen=" + key(20, b62), "AKIA" + key(14, "ABC0") + " AKIA" + key(13, "ABC0"), key(40, "0123456789abcdef"), "x" + key(40, b62) + "x", "theandtheotherwordtheandtheother", None, "", "deadbeef" * 4, "a" * 50]
    texts += [" ".join("the other word and then some".split()[rng.randrange(6)] for _ in range(200)) for _ in range(20)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[0], "x"), (0, texts[0], "x")]
    got = secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in by_id[i].base] == spans_by_brute(t or "")
        spans = [tuple(s) for s in by_id[i].spans]
        assert {tuple(s) for s in by_id[i].base} <= set(spans)
        assert spans == sorted(spans, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))
    assert any(s.kind == "random" for s in by_id[6].spans) and any(s.kind == "random" for s in by_id[7].spans)
    assert not any(s.kind == "random" for i in (8, 11, 12) for s in by_id[i].spans)
    assert secret_scan.scan_secrets(spark.createDataFrame([], DOCS)).collect() == []


def test_tokens_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    path = token_file.default_tokenizer()
    whole = Tokenizer.from_file(path)
    texts = ["I'm here's á e\u0301x", "a <|endoftext|> b", "x\x85y\x1cz", "don 't", "Straße ÀB; (Niño) THE. zz***", None, "", "word " * 40000, "İstanbul ΣΑΣ", "a" * 3000]
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, "last", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    token_file.write_tokens(docs, path, str(tmp_path / "t"), segment_ids=50)
    got = token_file.read_tokens(spark, str(tmp_path / "t"), with_ids=True).orderBy("start").collect()
    at = 0
    for r, (i, t) in zip(got, sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])), strict=True):
        ids = whole.encode(t, add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids, r.ids_crc32) == (i, at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    token_file.write_tokens(docs.limit(0), path, str(tmp_path / "e"))
    assert token_file.read_tokens(spark, str(tmp_path / "e")).collect() == []


def test_tokens_of_many_words_at_a_time(monkeypatch):
    from tokenizers import Tokenizer

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.calls = tokenizer, 0

        def encode(self, *args, **kwargs):
            self.calls += 1
            return self.tokenizer.encode(*args, **kwargs)

        def encode_batch_fast(self, *args, **kwargs):
            self.calls += 1
            return self.tokenizer.encode_batch_fast(*args, **kwargs)

    whole = Tokenizer.from_file(token_file.default_tokenizer())
    rng = random.Random(12)
    made = ["".join(rng.choices(token_file.PLAIN, k=rng.randint(1, 12))) for _ in range(9000)]
    texts = [" ".join(w.title() + rng.choice(["", "", ",", ".", "!?", '"']) for w in made[i : i + 900]) for i in range(0, 9000, 450)]
    encoder = token_file.Encoder(token_file.default_tokenizer(), 2)
    everything, model = Counted(encoder.words.tokenizer), Counted(encoder.words.bare)
    encoder.words.tokenizer, encoder.words.bare = everything, model
    assert list(encoder.encode(pa.array(texts))) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    assert model.calls <= 3 and everything.calls < 100  # marks, and what title() makes of ß, go through everything
    # few words kept, short slices, and white space of all kinds
    monkeypatch.setattr(token_file, "SLICE", 2000)
    monkeypatch.setattr(token_file, "WORDS", 7)
    encoder = token_file.Encoder(token_file.default_tokenizer(), 4, 20)
    texts += ["", " ", f"é{chr(0x301)} x"] + [f"a{chr(c)}b {chr(c)}" for c in range(0x110000) if chr(c).isspace() or (c % 997 == 0 and not 0xD800 <= c < 0xE000)]
    assert list(encoder.encode(pa.array(texts))) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("change", ["none", "case", "space", "suffix"])
def test_tokens_of_other_tokenizers(tmp_path, change):
    from tokenizers import Tokenizer

    steps = json.load(open(token_file.default_tokenizer()))
    if change == "case":
        steps["normalizer"]["normalizers"].pop()
    elif change == "space":
        steps["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    elif change == "suffix":
        steps["model"] = {"type": "WordLevel", "vocab": {"the": 0, ".": 1, "?": 2}, "unk_token": "?"}
    path = str(tmp_path / "t.json")
    json.dump(steps, open(path, "w"))
    whole, encoder = Tokenizer.from_file(path), token_file.Encoder(path, 4)
    texts = ["The the. THE  street (Straße), étude", "", "9 lives' it's"]
    for some in (texts, []):
        assert list(encoder.encode(pa.array(some, pa.string()))) == [np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]
    assert bool(encoder.words.bytes_of) == (change == "none")


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [5, 5, 7, 100, 100000], list(range(0, 3000, 3)), [1 << 31]])
def test_elias_fano(values):
    ef = token_file.EliasFano.of(np.array(values))
    assert [ef.select(i) for i in range(len(values))] == values == ef.values().tolist()
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_quality(spark):
    rng = random.Random(10)
    plain = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        kind = i % 4
        text = [rng.choice(plain) for _ in range(80)]
        if kind == 1:
            text = [w.upper() + "!!" for w in text]
        if kind == 2:
            text[10], text[40] = "vile", "nasty"
        rows.append((i, " ".join(text), "x"))
        if i < 200:
            labels.append((i, int(kind != 1), int(kind == 2)))
    rows += [(900, None, "x"), (901, "", "x"), (None, rows[0][1], "x"), (5, rows[5][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep string")
    marks = spark.createDataFrame(labels + [(None, 0, 1), (9999, 0, 0), (398, None, None)], "doc_id long, quality int, toxic int")
    got = quality.judged(docs, marks).collect()
    assert len(got) == len(rows)
    fresh = {r.doc_id: r.keep for r in got if r.doc_id is not None and 200 <= r.doc_id < 400}
    assert all(keep == (i % 4 in (0, 3)) for i, keep in fresh.items())
    assert all(r.keep for r in got if r.doc_id in (900, 901))
    kept = [r for r in got if r.keep]
    assert sum(r.selected for r in got) == -(-len(kept) // 2) or len({r.gumbel_key for r in kept}) < len(kept)
    assert quality.kept_rows(docs, marks).columns == docs.columns
    assert all(r.keep for r in quality.judged(docs, marks.limit(0)).collect())
    assert quality.judged(docs.limit(0), marks).collect() == []


def test_kth_largest(spark):
    values = [3.5, -2.0, 0.0, -0.0, 7e300, -1e-300, 3.5]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in range(1, len(values) + 1):
        assert quality.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def poured(amount, nodes):
    out, left = dict.fromkeys(nodes, 0.0), set(nodes)
    while left and amount > 1e-9:
        weight = sum(nodes[k][0] for k in left)
        full = {k for k in left if nodes[k][1] <= amount * nodes[k][0] / weight}
        if not full:
            return out | {k: amount * nodes[k][0] / weight for k in left}
        for k in full:
            out[k] = nodes[k][1]
            amount -= nodes[k][1]
        left -= full
    return out


def test_mixing(spark):
    rng = random.Random(11)
    rows = [(i, "w " * rng.randrange(40), rng.choice(["en", "de", None]), rng.choice(["src1", "src2", "src2", "src2", "odd", None]), "x") for i in range(500)]
    rows += [(0, rows[0][1], *rows[0][2:]), (None, "a b", "en", "src1", "x"), (700, None, "en", "src1", "x"), (701, "b " * 5000, "de", "src2", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, tokens string")
    leaves = mixing.leaf_columns(docs)
    got = mixing.mixed(leaves, mixing.WEIGHTS).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        key = (r.domain, r.lang, r.source)
        sizes[key] = sizes.get(key, 0) + r.tokens
        taken[key] = taken.get(key, 0) + sum(t.tokens for t in r.taken)
        assert all(0 < t.tokens <= r.tokens or r.tokens == 0 for t in r.taken)
        assert sum(t.tokens < r.tokens for t in r.taken) <= 1
    want = {}
    for domain, share in poured(sum(sizes.values()) * 0.5, {d: (mixing.WEIGHTS["domain"].get(d, 1.0), 2.0 * sum(n for k, n in sizes.items() if k[0] == d)) for d in {k[0] for k in sizes}}).items():
        langs = {k[1] for k in sizes if k[0] == domain}
        for lang, part in poured(share, {x: (mixing.WEIGHTS["lang"].get(x, 1.0), 2.0 * sum(n for k, n in sizes.items() if k[:2] == (domain, x))) for x in langs}).items():
            for source, amount in poured(part, {k[2]: (1.0, 2.0 * n) for k, n in sizes.items() if k[:2] == (domain, lang)}).items():
                want[domain, lang, source] = amount
    assert all(abs(taken[k] - want[k]) <= 1 for k in want)
    assert sum(t < 0 for t in taken.values()) == 0
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    lengths = sorted(len((r.text or "").split()) for r in out.collect())
    assert lengths == sorted(t.tokens for r in got for t in r.taken)  # a document cut by its leaf's budget ends there
    assert mixing.mixture(docs.limit(0)).collect() == []


def test_mixing_takes_documents_by_brute_order(spark):
    rng = random.Random(12)
    rows = [(i, "w " * rng.randrange(1, 30), "en", "src1") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    leaves = mixing.leaf_columns(docs).withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(mixing.SEED), F.lit(0), "row"), 1))
    order = sorted((r.h, r.doc_id, r.tokens) for r in leaves.collect())
    left, want = sum(t for *_, t in order) // 2, {}
    for _, i, t in order:
        if left > 0:
            want[i] = min(t, left)
            left -= t
    taken = {r.doc_id: r.taken[0].tokens for r in mixing.mixed(mixing.leaf_columns(docs), mixing.WEIGHTS).collect() if r.taken}
    assert taken == want


def test_first_tokens(spark):
    df = spark.createDataFrame([(" a  b\tc ", 2), ("a", 1), ("x y", 5)], "text string, n long")
    assert [r[0] for r in df.select(mixing.first_tokens(F.col("text"), F.col("n"))).collect()] == [" a  b", "a", "x y"]


NAMES = ["doc_id", "text", "lang", "source", "n_chars", "_row", "_number", "_time", "_times", "row", "root", "tokens", "taken", "whole", "_h", "doc", "Hits", "a b", "x.y"]


def test_stages_keep_columns_of_any_name(spark):
    from tallyforge.llm import near_copies

    rows = [(i, t, "en", "src1", 1, *[f"v{i}"] * 14) for i, t in [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, None), (None, "x"), (3, "very other words in here")]]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in NAMES))
    items = spark.createDataFrame([(1, "very other")], "item_id long, text string")
    marks = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    want = {"quality": 5, "near": 4, "clean": 4, "mix": None}
    got = {"quality": quality.kept_rows(docs, marks), "near": near_copies.one_of_each(docs), "clean": decontamination.clean(docs, items), "mix": mixing.mixture(docs)}
    for name, df in got.items():
        out = df.collect()
        assert df.columns == NAMES
        assert want[name] is None or len(out) == want[name]
        assert all(set(r[5:]) == {f"v{r.doc_id}"} for r in out)
        empty = {"quality": quality.kept_rows(docs.limit(0), marks), "near": near_copies.one_of_each(docs.limit(0)), "clean": decontamination.clean(docs.limit(0), items), "mix": mixing.mixture(docs.limit(0))}[name]
        assert empty.collect() == []


def test_digest_of_no_items(spark):
    docs = spark.createDataFrame([(1, "a b c", "")], DOCS)
    row = decontamination.judged(docs, spark.createDataFrame([(1, "x y", "")], ITEMS)).select(F.sha2(F.array_join("items", ","), 256).alias("d")).first()
    assert row.d == hashlib.sha256(b"").hexdigest()
