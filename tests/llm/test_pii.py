import hashlib
import random
import re

from tessera.llm import pii as p

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in RAW.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


CHARS = list("019. .-+@ab_%()é😀") + ["4111 1111 1111 1111", "1.2.3.4", "x@y.zz", "+1 (555) 010-9999", "255.255", "@@", "0000"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, email string")


def test_base(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice(CHARS) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "00000000000.0.0.0255", "x" * 60000, "a." * 30000, "1-" * 30000, "9" * 60000, "+1" + " " * 50000, "1." * 20000, "a@b" + ".c" * 20000, "1.2.3.4 " * 700]
    rows = [*enumerate(texts), (None, None), (1, "")]
    got = p.pii_digest(frame(spark, rows)).collect()
    want = []
    for k, t in rows:
        b = brute(t or "")
        told = ",".join(f"{kind}:{a}:{e}" for kind, a, e in b)
        want.append((str(k), *(sum(x[0] == kind for x in b) for kind in RAW), hashlib.sha256(told.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    assert p.pii_digest(frame(spark, rows).limit(0)).count() == 0


def test_disclosing_terms(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(3))
    rows = [(k, " ".join(word() for _ in range(60))) for k in range(300)]
    rows += [(1000 + k, f"{' '.join(word() for _ in range(20))} treasurer Quillfeather jo@corp.example {' '.join(word() for _ in range(20))}") for k in range(6)]
    # Copies give no support.
    rows += [(2000 + k, "mail Zanzibarian to me@copy.example for more of it") for k in range(20)]
    df = frame(spark, rows)
    got = {r.doc_id: r.spans for r in p.pii_digest(df).collect()}
    text = dict(rows)
    for k in range(1000, 1006):
        spans = [x.split(":") for x in got[k].split(",")]
        assert [text[k][int(a) : int(b)] for kind, a, b in spans if kind == "term"] == ["treasurer", "Quillfeather"]
        assert [text[k][int(a) : int(b)] for kind, a, b in spans if kind == "email"] == ["jo@corp.example"]
    assert all("term" not in v for k, v in got.items() if k < 1000 or k >= 2000)
    clean = {r.doc_id: r.text for r in p.sanitised(df).collect()}
    assert "Quillfeather" not in clean[1003] and "[EMAIL]" in clean[1003] and clean[5] == text[5]
    assert clean[2001] == "mail Zanzibarian to [EMAIL] for more of it"


def filler(rnd, n):
    return " ".join("".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(4)) for _ in range(n))


def test_copies_hide_no_term(spark):
    rnd = random.Random(11)
    rows = [(k, filler(rnd, 20)) for k in range(300)]
    rows += [(1000 + k, f"{filler(rnd, 12)} Quillfeather jo@corp.example {filler(rnd, 12)}") for k in range(3)]
    terms = lambda rows: {r.doc_id: r.spans.count("term") for r in p.pii_digest(frame(spark, rows)).collect()}
    copied = rows + [(2000 + k, rows[-1][1]) for k in range(400)]
    assert [terms(rows)[1000 + k] for k in range(3)] == [1, 1, 1]
    got = terms(copied)
    assert all(got[k] == (k >= 1000) for k, _ in copied)


def test_terms_far_and_short(spark):
    """Terms count and are marked anywhere in the texts that hold the entity, short ones too."""
    rnd = random.Random(12)
    rows = [(k, filler(rnd, 20)) for k in range(300)]
    rows += [(1000 + k, f"Kim 王小明 {filler(rnd, 15)} jo@corp.example {filler(rnd, 15)} corp Kim") for k in range(4)]
    # Held without the term's neighbour, and a text without the entity.
    rows += [(1010, f"{filler(rnd, 30)} jo@corp.example {filler(rnd, 200)} KIM {filler(rnd, 2)}"), (1011, f"{filler(rnd, 9)} lee")]
    df, text = frame(spark, rows), dict(rows)
    got = {r.doc_id: [text[r.doc_id][int(a) : int(b)] for kind, a, b in (x.split(":") for x in r.spans.split(",") if x) if kind == "term"] for r in p.pii_digest(df).collect()}
    assert all(got[1000 + k] == ["Kim", "王小明", "corp", "Kim"] for k in range(4))
    assert got[1010] == ["KIM"] and not any(v for k, v in got.items() if k < 1000 or k == 1011)
    clean = {r.doc_id: r.text for r in p.sanitised(df).collect()}
    assert "Kim" not in clean[1002] and "KIM" not in clean[1010] and "[EMAIL]" in clean[1010]
