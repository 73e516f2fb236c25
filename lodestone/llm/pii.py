"""Personal data by weak supervision, in DataFrame functions only.

Patterns yield candidate spans; labelers (form, checksum, gazetteer, context, boundary) vote on each. Votes are counted over
the whole corpus. Expectation-maximisation on the counts estimates how reliable each labeler is, per kind, and gives each
pattern of votes a probability; a logistic span classifier is trained on these. Spans of the base patterns that
pass their checks always stay; spans of the wider patterns are added if the classifier accepts them.

Only counts per code of votes reach the driver: at most 4 kinds x 3^4 votes x 2 sources of rows, whatever the corpus.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.common import cut
from lodestone.llm.base import table, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that no text makes them slow or deep: a run is entered at its start only and never given back.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider forms: spelled-out addresses, eight groups of hexadecimal digits, cards with points, numbers of three groups without country.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[({]dot[\])}]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63}){1,4}|\x20at\x20[A-Za-z0-9-]{1,63}(?:\x20dot\x20[A-Za-z0-9-]{1,63}){1,4})(?![A-Za-z0-9-])",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9._])[0-9]{4}(?:[._][0-9]{4}){3}(?![0-9._])",
    "phone": r"(?<![0-9A-Za-z+().-]|[0-9+().-]\x20)(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-]|[.\x20][0-9])",
}
#: Words that speak for, or against, personal data when they stand just before it.
FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|from|to|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|ips|ipv[46]|host|server|address|addr|login|client|from)\b",
    "card": r"(?i)\b(?:card|visa|master ?card|amex|credit|debit|payment|pay|tarjeta|carte|karte)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|fax|mobile|cell|contact|whatsapp|sms|telefon|tel[eé]fono|t[eé]l)\b",
}
AGAINST = r"(?i)\b(?:isbn|issn|doi|version|release|build|chapter|section|page|figure|table|sku|serial|part no|order no|invoice|ref|total|price)\b"
#: Gazetteers: endings of mail domains, private or reserved networks, issuers of cards, country codes of telephones.
KNOWN = {
    "email": r"(?i)(?:com|org|net|edu|gov|io|info|biz|de|fr|es|uk|it|nl|eu|us|ca|ch|at|be|pt|pl|mx|ar)$",
    "ip": r"^(?!0|10\.|127\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|22[4-9]\.|23[0-9]\.|24[0-9]\.|25[0-5]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)",
    "phone": r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|21[1-9]|35[0-9]|38[0-9]|42[01]|[2-9][0-9]{9}$)",
}
IP_PARTS = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
BEFORE, AFTER = 40, 8
#: A base and a wide pattern per kind.
SOURCES = [(k, w) for k in KINDS for w in (False, True)]
LABELERS = ("checks", "gazetteer", "context", "boundary")
ACCEPT = 0.5


def _needs(text: Column, kind: str, wide: bool) -> Column:
    """A cheap condition without which a pattern can't match."""
    if kind == "email":
        return (text.rlike(r"at[\])} ]") & text.rlike(r"[\[({ ]at[\])} ]")) if wide else text.contains("@")
    if kind == "ip" and wide:
        return text.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:")
    if kind == "phone" and not wide:
        return text.contains("+")
    return text.rlike("[0-9]")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum of cards."""
    backwards = F.split(F.reverse(digits), "")
    values = F.transform(backwards, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def _hits(found: Column, gaps: Column) -> Column:
    """Hits with the length of the gap before each and some text of both gaps beside it."""
    n = F.size(found)
    sides = F.zip_with(F.slice(gaps, 1, n), F.slice(gaps, 2, n), lambda x, y: F.struct(F.length(x).alias("gap"), F.substring(x, -BEFORE, BEFORE).alias("before"), F.substring(y, 1, AFTER).alias("after")))
    return F.zip_with(found, sides, lambda m, s: F.struct(m.alias("found"), s["gap"].alias("gap"), s["before"].alias("before"), s["after"].alias("after")))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row, a row number and an array of hits per pattern, each with the gap before it and a little text on both sides.

    The only pass over the texts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("body"))
    body = F.col("body")
    none = F.array().cast("array<string>")
    for kind, wide in SOURCES:
        found = F.when(_needs(body, kind, wide), F.regexp_extract_all(body, F.lit((WIDE if wide else BASE)[kind]), F.lit(0))).otherwise(none)
        rows = rows.withColumn(f"m_{kind}_{wide}", found)
    for kind, wide in SOURCES:
        gaps = F.when(F.size(f"m_{kind}_{wide}") > 0, F.split(body, (WIDE if wide else BASE)[kind], -1)).otherwise(none)
        rows = rows.withColumn(f"g_{kind}_{wide}", gaps)
    hits = [_hits(F.col(f"m_{k}_{w}"), F.col(f"g_{k}_{w}")).alias(f"hits_{k}_{w}") for k, w in SOURCES]
    return rows.select("doc_id", *hits).withColumn("rid", F.monotonically_increasing_id())


def _by_kind(value) -> Column:
    out = F
    for i, kind in enumerate(KINDS):
        out = out.when(F.col("kind") == i, value(kind))
    return out


def _vote(yes: Column, no: Column) -> Column:
    """2 for personal data, 0 against, 1 for no opinion."""
    return F.when(yes, 2).when(no, 0).otherwise(1)


def spans_of(hits: DataFrame) -> DataFrame:
    """A row per hit: rid, kind, wide, start, end, whether it passes the check of its kind, and the code of its votes."""
    tagged = [F.struct(F.lit(KINDS.index(k)).alias("kind"), F.lit(w).alias("wide"), F.col(f"hits_{k}_{w}").alias("hits")) for k, w in SOURCES]
    lists = hits.select("rid", F.explode(F.array(*tagged)).alias("s")).select("rid", "s.kind", "s.wide", F.posexplode("s.hits").alias("place", "h"))
    so_far = Window.partitionBy("rid", "kind", "wide").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lists.select("rid", "kind", "wide", "place", "h.*").withColumn("end", F.sum(F.col("gap") + F.length("found")).over(so_far))
    rows = rows.withColumn("start", F.col("end") - F.length("found")).withColumn("digits", F.regexp_replace("found", "[^0-9]", "")).withColumn("n", F.length("digits"))
    rows = rows.withColumn("luhn", F.when(F.col("kind").eqNullSafe(KINDS.index("card")) & F.col("n").between(13, 19), luhn(F.col("digits"))).otherwise(False))
    octets = F.col("found").rlike(IP_PARTS)
    ok = {"email": F.lit(True), "ip": octets, "card": F.col("luhn"), "phone": F.col("n").between(9, 15)}
    sure = {"email": _vote(~F.col("wide"), F.lit(False)), "ip": _vote(octets | F.col("wide"), F.lit(True)), "card": _vote(F.col("luhn"), F.lit(True)), "phone": _vote(ok["phone"], F.lit(True))}
    subject = {k: F.col("digits") if k in ("card", "phone") else F.lower("found") for k in KINDS}
    known = {k: _vote(subject[k].rlike(KNOWN[k]), F.lit(k in ("card", "phone"))) for k in KINDS}
    against = F.col("before").rlike(AGAINST)
    context = {k: _vote(F.col("before").rlike(FOR[k]), against) for k in KINDS}
    inside = F.col("before").rlike(r"[A-Za-z0-9_/=#&%]$") | F.col("after").rlike(r"^[A-Za-z0-9_/=%]")
    rows = rows.withColumn("ok", _by_kind(ok.get)).withColumn("v0", _by_kind(sure.get)).withColumn("v1", _by_kind(known.get)).withColumn("v2", _by_kind(context.get)).withColumn("v3", _vote(~inside, inside))
    code = ((((F.col("kind") * 2 + F.col("wide").cast("int")) * 3 + F.col("v0")) * 3 + F.col("v1")) * 3 + F.col("v2")) * 3 + F.col("v3")
    return rows.select("rid", "kind", "wide", "start", "end", "ok", code.cast("int").alias("code"))


def _unpack(code: int) -> tuple[int, int, tuple[int, ...]]:
    found = []
    for _ in LABELERS:
        found.append(code % 3)
        code //= 3
    return code // 2, code % 2, tuple(reversed(found))


def reliabilities(counts: dict[int, int], rounds: int = 50) -> tuple[dict[int, float], dict[int, list]]:
    """Expectation-maximisation over counts of vote codes: probability of each code, and per kind the chances of each vote."""
    chance, tables = {}, {}
    for kind in range(len(KINDS)):
        mine = {c: n for c, n in counts.items() if _unpack(c)[0] == kind}
        if not mine:
            continue
        # begin with the share of votes in favour; a vote of the checks counts twice
        p = {}
        for c in mine:
            v = _unpack(c)[2]
            p[c] = min(0.95, max(0.05, 0.5 + (2 * (v[0] - 1) + sum(x - 1 for x in v[1:])) / 8))
        for _ in range(rounds):
            prior = (sum(n * p[c] for c, n in mine.items()) + 1) / (sum(mine.values()) + 2)
            given = [[[1.0, 1.0, 1.0], [1.0, 1.0, 1.0]] for _ in LABELERS]
            for c, n in mine.items():
                for j, v in enumerate(_unpack(c)[2]):
                    given[j][1][v] += n * p[c]
                    given[j][0][v] += n * (1 - p[c])
            given = [[[x / sum(row) for x in row] for row in both] for both in given]
            for c in mine:
                odds = log(prior / (1 - prior)) + sum(log(given[j][1][v] / given[j][0][v]) for j, v in enumerate(_unpack(c)[2]))
                p[c] = 1 / (1 + exp(-max(-30.0, min(30.0, odds))))
        chance |= p
        tables[kind] = given
    return chance, tables


def features(code: int) -> list[int]:
    """Places of the classifier's features that are on: kind, and each vote, alone and with the kind."""
    kind, _, v = _unpack(code)
    n = len(LABELERS)
    return [kind, *(len(KINDS) + j * 3 + x for j, x in enumerate(v)), *(len(KINDS) + 3 * n + (kind * n + j) * 3 + x for j, x in enumerate(v))]


def train(counts: dict[int, int], chance: dict[int, float], steps: int = 300, rate: float = 0.5, penalty: float = 1e-3) -> list[float]:
    """Logistic regression on the counted codes with their probabilities as soft labels."""
    w = [0.0] * (len(KINDS) + 3 * len(LABELERS) * (1 + len(KINDS)))
    # codes weigh by the logarithm of their counts, so a kind that fills the corpus does not decide for the others
    weight = {c: log(1 + n) for c, n in counts.items()}
    total = sum(weight.values()) or 1.0
    for _ in range(steps):
        slope = [penalty * x for x in w]
        for c, h in weight.items():
            miss = h * (1 / (1 + exp(-max(-30.0, min(30.0, sum(w[i] for i in features(c)))))) - chance[c]) / total
            for i in features(c):
                slope[i] += miss
        w = [x - rate * 4 * s for x, s in zip(w, slope, strict=True)]
    return w


def accepted(counts: dict[int, int]) -> list[int]:
    """Codes of wide spans that the classifier accepts: its score reaches one half, and no check or boundary speaks against."""
    chance, _ = reliabilities(counts)
    w = train(counts, chance)
    wide = [c for c in counts if _unpack(c)[1] == 1]
    return [c for c in wide if 1 / (1 + exp(-sum(w[i] for i in features(c)))) >= ACCEPT and _unpack(c)[2][0] != 0 and _unpack(c)[2][3] != 0]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    Spans are kind:start:end in code points, end exclusive, by kind and start, joined by commas. A null text counts as empty, with the
    digest of nothing. Spans of one kind never overlap. Repeated rows get equal rows; an empty table gives none; other columns are
    ignored. The texts are scanned once; hits and their surroundings are written, all else reads those. Only hits are shuffled.
    """
    hits = cut(candidates(docs, id_col, text_col), "hits")
    spans = cut(spans_of(hits), "spans")
    counts = spans.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()
    good = accepted({r["code"]: r["n"] for r in counts})
    base = ~F.col("wide") & F.col("ok")
    spans = spans.filter(base | (F.col("wide") & F.col("code").isin(good)) if good else base)
    # an added span gives way to a base span that it touches: base spans lie apart, so the nearest ones on both sides tell
    by_start = Window.partitionBy("rid", "kind").orderBy("start", "end")
    before = F.max(F.when(~F.col("wide"), F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(~F.col("wide"), F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    apart = (F.coalesce(before, F.lit(-1)) <= F.col("start")) & (F.coalesce(after, F.col("end")) >= F.col("end"))
    kept = spans.withColumn("apart", apart).filter("NOT wide OR apart")
    sorted_spans = F.array_sort(F.collect_list(F.struct("kind", "start", "end", "wide")))
    listed = kept.groupBy("rid").agg(sorted_spans.alias("s"), *(F.count(F.when((F.col("kind") == i) & ~F.col("wide"), 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)))
    names = F.array(*(F.lit(k) for k in KINDS))
    written = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
    texts = listed.select("rid", *(f"n_{k}" for k in KINDS), written(F.filter("s", lambda x: ~x["wide"])).alias("base"), written(F.col("s")).alias("spans"))
    out = hits.select("rid", "doc_id").join(texts, "rid", "left")
    return out.select(
        F.col("doc_id").alias(id_col),
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def op10_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
