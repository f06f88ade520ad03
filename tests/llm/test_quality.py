import random
import re

from tessera.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts():
    rnd = random.Random(5)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "b", "é", " ", " ", "\n", "\x85", "\xa0", "#", "|", "\t", "\x0b"]) for _ in range(rnd.randint(0, 200)))
        assert q.counts(text) == brute(text)
    text = " ".join("abcdefgh") * 500
    assert q.counts(text) == brute(text)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, kept int")


def test_boilerplate(spark):
    prose = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(k, f"{prose(k)}\nAll  rights\treserved by us", "h") for k in range(40)]
    # Mostly boilerplate: two common lines and little else.
    rows += [(100 + k, f"{'Share this page with friends now please ' * 5}\nonly{k}", "h") for k in range(40)]
    # Copies are one document.
    rows += [(200 + k, prose("copy"), "h") for k in range(40)] + [(300 + k, prose("copy") + "\nother line", "g") for k in range(30)]
    rows += [(400, None, None), (None, "", "h"), (401, prose("z"), None)]
    got = {(r.doc_id): r for r in q.quality_digest(frame(spark, rows)).collect()}
    assert all(got[k].kept and got[k].removed_words == 5 for k in range(40))
    assert not any(got[100 + k].kept for k in range(40))
    assert all(got[200 + k].kept and got[200 + k].removed_words == 0 for k in range(40))
    assert all(got[300 + k].kept for k in range(30))
    assert not got[400].kept and not got[None].kept and got[401].kept
    kept = q.keep_good(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "kept"]
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) == {k for k, r in got.items() if r.kept}
    assert texts[3] == prose(3)
    assert q.quality_digest(frame(spark, rows).limit(0)).count() == 0
    assert q.keep_good(frame(spark, rows).limit(0)).count() == 0


def test_repeated_rows(spark):
    rows = [(1, "a b c " * 2 + " ".join(map(str, range(30))), "s")] * 3
    assert q.quality_digest(frame(spark, rows)).count() == 3 and q.keep_good(frame(spark, rows)).count() == 3


def test_template_of_several_lines(spark):
    """Documents that share a template are different documents for each of its lines, copies of them aren't."""
    template = "\n".join(f"template line number {k} of the site" for k in range(10))
    own = lambda k: f"page {k} " + " ".join(f"p{k}x{i}" for i in range(100))
    rows = [(k, f"{template}\n{own(k)}", "h") for k in range(100)] + [(200 + k, f"{own('copy')}\nline of the copies", "g") for k in range(100)]
    rows += [(400 + k, "one single line that stands in documents of one line only " * 2, "g") for k in range(30)]
    got = {r.doc_id: r for r in q.quality_digest(frame(spark, rows)).collect()}
    assert all(got[k].removed_words == 70 and got[k].kept for k in range(100))
    assert all(r.removed_words == 0 for k, r in got.items() if k >= 200)
