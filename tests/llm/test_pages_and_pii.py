"""Page text and personal data against brute force."""

import hashlib
import html
import random
import re

import pytest

from lodestone.llm import html_text, pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def truth(page):
    body = page[page.index("<article>") + 9 :].split("</article>")[0]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", body))
    return "\n".join(p for p in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in parts) if p)


def test_pages_equal_their_article(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    found = html_text.extract_text(pages).collect()
    assert len(found) == len(source)
    for r in found:
        assert r.text == truth(source[r.page_id]) and r.n_chars == len(r.text)


def test_pages_without_article_use_what_others_teach(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    weights = html_text.learn_weights(pages)
    for r in pages.collect():
        assert html_text.main_text(r.html.replace("<article>", "").replace("</article>", ""), weights) == truth(r.html)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a &lt;b&gt; c&nbsp;d</p>", "a <b> c d"),
        ("<div title='x>y'>one\n two</div><script>no()</script>", "one two"),
        ("<!-- never closed", ""),
        ("<nav>Menu</nav><main><h1>T</h1><p>Some words of text here.</p><div class='comment-list'>nice</div><aside>x</aside><form>f</form></main><footer>c</footer>", "T\nSome words of text here."),
    ],
)
def test_page_forms(page, want):
    assert html_text.main_text(page, {}) == want


def test_pages_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (2, None, ""), (None, "u", "<p>x</p>"), (3, "u", "<p>word " * 20000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    found = sorted((str(r.page_id), r.n_chars) for r in html_text.extract_text(frame).collect())
    assert found == [("1", 0), ("2", 0), ("2", 0), ("3", 99999), ("None", 1)]
    assert html_text.extract_text(frame.filter("false")).count() == 0


def luhn(digits):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in found.split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k in BASE for m in re.finditer(BASE[k], text) if passes(k, m.group())]


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab0123456789...@@++-- ()é😀_,") for _ in range(rng.randint(1, 200))) for _ in range(600)]
    texts += ["", "a@b.c_d@e.f", "4539 1488 0343 6467, 4539-1488-0343-6468", "300.1.1.1 1.2.3.4.5.6.7.8 001.002.003.255", "+1 (743) 555-3824 +12 +" + "1" * 20, None]
    rows = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        want = spans(text or "")
        r = rows[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in BASE]
        assert set(want) <= set(r.spans.split(",")) | {""}


def test_wide_forms_are_added_apart_from_base_spans(spark):
    rng = random.Random(4)
    texts = [f"call me at +1 (743) 555-{rng.randint(1000, 9999)} today" for _ in range(60)] + [f"phone (743) 555-{rng.randint(1000, 9999)} now" for _ in range(60)]
    rows = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(rows[i] == "phone:11:28" for i in range(60))
    assert all(rows[i] == "phone:6:20" for i in range(60, 120))


def test_pii_long_runs(spark):
    texts = ["1" * 200000, "a" * 200000, "a@b.co " * 2000, "1.2.3.4 " * 2000, "+" + "1 " * 50000]
    rows = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[2].n_email == 2000 and rows[3].n_ip == 2000 and rows[0].n_card == rows[1].n_email == rows[4].n_phone == 0
    assert rows[2].spans.split(",")[1999] == "email:13993:13999"


def test_pii_odd_rows(odd, none):
    assert pii.personal_data(odd).count() == odd.count()
    assert pii.personal_data(none).count() == 0
