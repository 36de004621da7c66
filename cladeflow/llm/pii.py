"""Operator 9: personal data by weak supervision, in DataFrame functions only.

Base spans are the contract's: email, ip, card and phone, each by its pattern and check; they always stay.  Further
candidates are looser forms: obfuscated addresses, IPv6, card-like runs that fail the checksum, phone numbers without
a plus.  On every candidate, base ones too,

- labelers vote yes, no or nothing: strict pattern, checksum and shape, gazetteers (top-level domains, issuer digits,
  area codes, reserved networks), words in front, hindering surroundings;
- expectation-maximisation over the counts of vote patterns (at most 4 * 3^5 rows, whatever the corpus) estimates how
  reliable each labeler is for each kind and how likely each pattern is a true span;
- a naive-Bayes span classifier over shape features and votes is trained on those likelihoods, from sums over all
  candidates, and decides on the looser ones.

Only a looser span that the classifier takes for likelier than ``least`` and that touches no base span is added.
Null and empty texts have no spans; repeated rows are returned each; ids pass through, null too; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F

from .common import write_table
from .spans import located

KINDS = ("email", "ip", "card", "phone")
#: Equal to the contract's patterns on every text, but with no rescans: a run can only match from its first character
#: or from the end of the match before, and no quantifier gives back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"
#: Looser forms of a kind.
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[{]\x20?(?:at|@)\x20?[)\]}]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:[(\[{]\x20?(?:dot|\.)\x20?[)\]}]|\.)\x20?[A-Za-z0-9-]{1,63}+){1,6}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "phone": r"(?<![+0-9.(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9.-])",
}
#: Words in front of a span that speak for its kind, and for none.
CUES = {"email": r"(?i)(?:e-?mail|contact|write to|reach)\W*(?:\w+\W+){0,2}$", "ip": r"(?i)(?:\bip\b|address|host|server|login)\W*(?:\w+\W+){0,2}$", "card": r"(?i)(?:card|visa|credit|debit|payment|pan)\W*(?:\w+\W+){0,2}$", "phone": r"(?i)(?:phone|tel|call|mobile|fax|cell)\W*(?:\w+\W+){0,2}$"}
AGAINST = r"(?i)(?:version|order|invoice|isbn|serial|sku|item|id|no|nr|#|v|sha|commit)[.:=#\s]*$"
DOMAINS = ("com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "us", "it", "nl", "ch", "at")
VOTES = ("strict", "check", "gazetteer", "cue", "around")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Do the digits of x pass the Luhn checksum?"""
    d = F.reverse(digits(x))
    values = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.when(i % 2 == 1, F.substring(d, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), F.substring(d, i, F.lit(1)).cast("int") + 1)))
    return F.when(F.length(d) > 0, F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0).otherwise(F.lit(False))


def passes(kind: str, x: Column) -> Column:
    n = F.length(digits(x))
    return {"email": F.lit(True), "ip": x.rlike(OCTETS), "card": n.between(12, 19) & luhn(x), "phone": n.between(9, 15)}[kind]


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def votes(kind: str, s: Column, base: Column) -> Column:
    """The five labelers' votes on span s."""
    text, n, nothing = s["text"], F.length(digits(s["text"])), F.lit(False)
    check = {
        "email": vote(~text.rlike(r"\.\.|^\.|[-.]@"), text.rlike(r"\.\.|^\.|[-.]@")),
        "ip": vote(text.rlike(OCTETS), ~text.rlike(OCTETS) & ~text.contains(":")),
        "card": vote(luhn(text), ~luhn(text)),
        "phone": vote(n.between(10, 13), ~n.between(9, 15)),
    }[kind]
    known = {
        "email": vote(F.lower(F.regexp_extract(text, "([A-Za-z]+)$", 1)).isin(*DOMAINS), nothing),
        "ip": vote(text.rlike(r"^(?:10|127|172|192)\.|^2[0-9a-f]{3}:"), text.rlike(r"^0\.|^255\.")),
        "card": vote(digits(text).rlike(r"^(?:4|5[1-5]|3[47]|6011|65|2[2-7])"), digits(text).rlike(r"^(?:0|9)")),
        "phone": vote(text.rlike(r"^\+(?:1|33|34|49|44|39)[^0-9]|^\(?[2-9]"), digits(text).rlike(r"^0{3}|(?:1234567|0000000)")),
    }[kind]
    around = vote(nothing, s["after"].rlike(r"^[A-Za-z0-9_]") | s["before"].rlike(r"[A-Za-z0-9_#$]$"))
    return F.array(F.when(base, F.lit(1)).otherwise(F.lit(0)), check, known, vote(s["before"].rlike(CUES[kind]), s["before"].rlike(AGAINST)), around)


def shape(s: Column) -> Column:
    """Discrete shape features of a span, as text."""
    kind_of = lambda c: F.when(c == "", "end").when(c.rlike(r"\s"), "space").when(c.rlike(r"\p{L}"), "letter").when(c.rlike("[0-9]"), "digit").otherwise("mark")
    return F.array(
        F.concat(F.lit("length "), F.least(F.floor(F.length(s["text"]) / 4), F.lit(12)).cast("string")),
        F.concat(F.lit("before "), kind_of(F.right(s["before"], F.lit(1)))),
        F.concat(F.lit("after "), kind_of(F.substring(s["after"], 1, 1))),
        F.concat(F.lit("parts "), F.least(F.size(F.split(s["text"], r"[^A-Za-z0-9]+")), F.lit(8)).cast("string")),
    )


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, spans)``: every candidate with kind, place, whether it is a base span, votes and shape; no text is kept."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    df = df.select("id", "text", (F.contains("text", F.lit("@"))).alias("has_at"), F.col("text").rlike(r"[(\[{]\x20?(?:[aA][tT]|@)\x20?[)\]}]").alias("has_loose_at"), F.col("text").rlike("[0-9]").alias("has_digit"))
    none = F.array().cast("array<struct<start:int,end:int,text:string,before:string,after:string>>")
    here = {"email": "has_at", "ip": "has_digit", "card": "has_digit", "phone": "has_digit"}
    cols = [F.when(F.col(here[k]), located(F.col("text"), BASE[k])).otherwise(none).alias(k) for k in KINDS]
    cols += [F.when(F.col("has_loose_at" if k == "email" else "has_digit"), located(F.col("text"), p)).otherwise(none).alias(f"loose_{k}") for k, p in LOOSE.items()]
    df = df.select("id", *cols)

    def judged(kind: str, strict: bool, column: str) -> Column:
        def one(s: Column) -> Column:
            base = passes(kind, s["text"]) if strict else F.lit(False)
            return F.struct(F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("k"), s["start"].alias("start"), s["end"].alias("end"), base.alias("base"), votes(kind, s, base).alias("votes"), shape(s).alias("shape"))

        return F.transform(F.col(column), one)

    parts = [judged(k, True, k) for k in KINDS] + [judged(k, False, f"loose_{k}") for k in LOOSE]
    return df.select("id", F.concat(*parts).alias("spans"))


def reliabilities(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> dict[tuple[str, tuple[int, ...]], float]:
    """Expectation-maximisation over vote patterns: the likelihood that a candidate of each pattern is true.

    Per kind, each labeler has a table P(vote | true) and P(vote | false), smoothed by a count of one; at the start a
    pattern's likelihood is a logistic of the sum of its votes.
    """
    out: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind in sorted({k for k, _, _ in counts}):
        rows = [(v, n) for k, v, n in counts if k == kind]
        like = {v: 1 / (1 + math.exp(-sum(v))) for v, _ in rows}
        for _ in range(rounds):
            true = 1 + sum(n * like[v] for v, n in rows)
            false = 1 + sum(n * (1 - like[v]) for v, n in rows)
            table: dict[tuple[int, int, bool], float] = defaultdict(lambda: 1.0)
            for v, n in rows:
                for j, x in enumerate(v):
                    table[j, x, True] += n * like[v]
                    table[j, x, False] += n * (1 - like[v])
            for v, _ in rows:
                odds = math.log(true / false) + sum(math.log(table[j, x, True] / (true + 2)) - math.log(table[j, x, False] / (false + 2)) for j, x in enumerate(v))
                like[v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        out |= {(kind, v): like[v] for v, _ in rows}
    return out


def _lookup(table: dict[str, float], key: Column) -> Column:
    pairs = [F.lit(x) for kv in sorted(table.items()) for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(0.0)) if pairs else F.lit(0.0)


def train(marked: DataFrame) -> dict[str, float]:
    """Weights of the span classifier: log-odds of each kind and of each of its features.  Bounded: a few hundred."""
    each = marked.select(F.explode("spans").alias("s"))
    got = each.groupBy(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 4 * 3^5 rows
    like = reliabilities(sorted((r["kind"], tuple(r["votes"]), r["n"]) for r in got))
    pattern = F.concat_ws("|", F.col("s.kind"), F.array_join(F.col("s.votes").cast("array<string>"), ","))
    belief = _lookup({f"{k}|{','.join(map(str, v))}": p for (k, v), p in like.items()}, pattern)
    named = F.concat(F.col("s.shape"), F.transform(F.col("s.votes"), lambda v, i: F.concat(F.lit("vote "), i.cast("string"), F.lit(" "), v.cast("string"))), F.array(F.lit("all")))
    sums = each.select(F.col("s.kind").alias("kind"), belief.alias("p"), F.explode(named).alias("f")).groupBy("kind", "f").agg(F.sum("p").alias("true"), F.sum(1 - F.col("p")).alias("false")).collect()  # kinds * features
    total = {r["kind"]: (r["true"], r["false"]) for r in sums if r["f"] == "all"}
    weights = {}
    for r in sums:
        t, f = total[r["kind"]]
        weights[f"{r['kind']}|{r['f']}"] = math.log((t + 1) / (f + 1)) if r["f"] == "all" else math.log((r["true"] + 1) / (t + 8)) - math.log((r["false"] + 1) / (f + 8))
    return weights


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.9) -> DataFrame:
    """``(id, spans)`` with spans an array of (kind, start, end, base), by start and then kind; see the module."""
    marked = write_table(candidates(docs, id_col, text_col), "candidates")
    weights = train(marked)

    def odds(s: Column) -> Column:
        named = F.concat(s["shape"], F.transform(s["votes"], lambda v, i: F.concat(F.lit("vote "), i.cast("string"), F.lit(" "), v.cast("string"))), F.array(F.lit("all")))
        return F.aggregate(named, F.lit(0.0), lambda a, f: a + _lookup(weights, F.concat_ws("|", s["kind"], f)))

    base = F.filter("spans", lambda s: s["base"])
    likely = F.filter("spans", lambda s: ~s["base"] & (odds(s) >= math.log(least / (1 - least))))
    split = marked.select("id", base.alias("base"), likely.alias("likely"))
    clear = F.filter("likely", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    order = F.transform(F.concat("base", clear), lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")))
    return split.select(F.col("id").alias(id_col), F.sort_array(order).alias("spans"))


def summary(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns: counts and digests of base spans, and all spans as one string."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select(id_col, *map(count, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return summary(find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet")))
