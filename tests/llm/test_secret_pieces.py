import random

from tallyforge.llm import secret_scan


def test_names_and_paths_are_no_part_of_a_token(spark):
    rng = random.Random(11)
    key = lambda n, name: "".join(rng.choice(secret_scan.ENCODINGS[name]) for _ in range(n))
    a, b, c = key(60, "base64") + "/+", key(60, "base62"), "-_" + key(60, "base62")
    texts = [f"AWS_SECRET_ACCESS_KEY={a}==", f"https://x.org/?sig={b}&v=1", f"see /srv/keys/{c} now"]
    want = [(a + "==",), (b,), (c,)]
    for text, (token,) in zip(texts, want, strict=True):
        assert token in [text[t[0] : t[1]] for t in secret_scan.tested_tokens(text)]
    texts += [" ".join("the other word and then some".split()[rng.randrange(6)] for _ in range(200)) for _ in range(20)]
    got = {r.doc_id: r for r in secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, (token,) in enumerate(want):
        at = texts[i].index(token)
        assert ("random", at, at + len(token)) in [tuple(s) for s in got[i].spans]
