import re

from pyspark.sql import functions as F

from lodestone.functions import rules as R
from lodestone.functions import text as X
from lodestone.functions import values as V


def one(frame, values, expr, schema="v string"):
    return [r[0] for r in frame([(v,) for v in values], schema).select(expr).collect()]


def test_norm_text_possessive_needs_a_blank(frame):
    assert one(frame, ["Krabbe's  Disease", "the Fabry’s x", "Pompe's", None, " A--B "], X.norm_text("v")) == ["krabbe disease", "the fabry x", "pompe s", "", "a b"]


def test_frequency(frame):
    assert one(frame, ["HP:0040281", "3/4", "2/0", "12.5%", "often", None], R.freq_value("v")) == [0.9, 0.75, None, 0.125, None, None]


def test_country(frame):
    got = one(frame, ["Univ, Kyoto, Japan 606", "Dept, Boston, MA 02115", "X, U.S.A. a@b.org", "Y, España. Electronic address: q", "", "a very long place name indeed"], R.country_of("v"))
    assert got == ["japan", "usa", "usa", "spain", "", ""]


def test_names(frame):
    assert one(frame, ["Teruyuki K", "J-P", "Zoë-Ann", None], R.forename("v")) == ["teruyuki", "", "zoe", ""]
    assert one(frame, ["Müller-Lüdenscheidt"], R.surname_key("v")) == ["mullerludenscheidt"]


def test_stop_reason_benign_before_safety(frame):
    why = ["Objectives were met, no safety issue", "Lack of efficacy", "Funding", "", None]
    df = frame([("Terminated", w) for w in why] + [("COMPLETED", "safety")], "s string, w string")
    assert [r[0] for r in df.select(R.stop_weight("s", "w")).collect()] == [0.1, 0.7, 0.25, 0.3, 0.3, None]


def test_negative_signal_reads_the_title_first(frame):
    df = frame([("No significant benefit of X", "it failed to improve"), ("Plain", "It did not significantly improve"), ("Plain", "fine")], "t string, a string")
    assert [r[0] and tuple(r[0]) for r in df.select(R.negative_signal("t", "a")).collect()] == [
        ("title", "No significant benefit"), ("abstract", "did not significantly improve"), None]


def test_units_keep_markers_and_lists(frame):
    text = "First one. [1] Second [2]. Third\n- item. with dot\n\nLast?"
    got = [tuple(u) for u in one(frame, [text], X.split_units("v"))[0]]
    assert got == [(1, False, "First one. [1]"), (1, False, "Second [2]."), (1, False, "Third"), (2, True, "- item. with dot"), (4, False, "Last?")]
    back = one(frame, [text], F.array_join(F.transform(X.answer_pieces("v"), lambda p: F.concat(p["sep"], p["unit"])), ""))[0]
    assert back == text


def test_grade_matches_a_plain_count(frame):
    text = "The table sees a tree. It is made late [e1]. Apple!"
    words = re.findall(r"[A-Za-z][A-Za-z'-]*", re.sub(r"\[e?\d+\]", "", text))

    def syl(w):
        w = re.sub("[^a-z]", "", w.lower())
        n = len(re.findall("[aeiouy]+", w))
        return max(n - (w.endswith("e") and not w.endswith(("le", "ee")) and n > 1), 1)

    want = 0.39 * len(words) / 3 + 11.8 * sum(map(syl, words)) / len(words) - 15.59
    assert abs(one(frame, [text], X.readability_grade("v"))[0] - want) < 1e-9


def test_recency_and_urls(frame):
    assert [round(x, 3) for x in one(frame, ["2008", "2000-01-01", "1950", "", None], R.recency("v", 2010))] == [1.0, 0.95, 0.85, 1.0, 1.0]
    assert one(frame, ["PMID:7", "R-HSA-1", "x", None], R.source_url("v")) == ["https://pubmed.ncbi.nlm.nih.gov/7/", "https://reactome.org/content/detail/R-HSA-1", "", ""]


def test_evidence_pmids(frame):
    df = frame([("PMID:1", ["2", "PMID:1", "OMIM:3"]), ("OMIM:9", None)], "s string, l array<string>")
    assert [r[0] for r in df.select(R.evidence_pmids("s", "l")).collect()] == [["PMID:1", "PMID:2"], []]


def test_prevalence(frame):
    spec = "array<struct<type:string,class:string,geographic:string,validation:string,val_moy:string>>"
    recs = [("Annual incidence", "1-5", "Europe", "Validated", ""), ("Point prevalence", "1-9", "Worldwide", "Validated", ""), ("Point prevalence", "", "Worldwide", "Validated", "0.0")]
    assert one(frame, [recs, []], R.prevalence_summary("v"), f"v {spec}") == ["1-9 - Point prevalence, Worldwide", None]


def test_word_boundaries_are_those_of_ascii(frame):
    # as in the SQL: an accented letter ends a word
    got = one(frame, ["la noñbogación", "noble", "no", "x_no", "Ño NO."], F.col("v").rlike(R.any_case(V.HEDGE)))
    assert got == [True, False, True, False, True]
    assert one(frame, ["un ñmouseñ", "dormouses"], R.first_match(F.col("v"), V.MODEL_SYSTEM)) == ["mouse", ""]
