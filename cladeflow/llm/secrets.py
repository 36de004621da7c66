"""Operator 4: secrets in texts, with a random forest against false positives, in DataFrame functions only.

Candidates are private-key blocks, runs of credential characters that hold a digit (16 or more), and shorter ones (8 or
more) that are assigned to something or follow a word such as "password" (16 letters alone, unassigned, are none).  For
each, features: length, character transitions, dictionary coverage, path, neighbouring words.  The dictionary is the
texts' own: their ``DICTIONARY`` most frequent words.  A forest (spark.ml) is trained on labelled findings, given as a
table of at most ``FINDINGS`` rows or made; its trees become one SQL expression, so scanning is a single projection over
the texts, with no join and no shuffle.

Offsets are code points, end exclusive.  Null and empty texts have no findings; repeated rows are returned each; ids
pass through, null too; an empty table gives no rows.  ``scan`` reads the id and the text only; ``redact`` keeps all
other columns, whatever their names.
"""

from __future__ import annotations

import functools
import random
import re
import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .spans import kept, located

PRIVATE = r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----[^-]*+(?:-(?!----)[^-]*+){0,64}+-----END [A-Z ]{0,24}PRIVATE KEY-----"
LED = r"(?<=(?:[=:]|=>|(?:password|passwd|secret|token)(?:\x20is)?\x20?)\x20{0,2}[\"']?)"
#: A run to which something is assigned is a name.
UNASSIGNED = r"(?!=[\"']?[A-Za-z0-9+/_-]{4}|\x20?(?:=>?|:)\x20[\"'][A-Za-z0-9]{4})"
CANDIDATE = PRIVATE + r"|(?<![A-Za-z0-9+/_-])(?:(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+|(?=[A-Za-z0-9+/_.!@#$%^&*-]{8})" + LED + r"[A-Za-z0-9+/_.!@#$%^&*-]{8,}+)" + UNASSIGNED + "={0,2}"
KEYWORDS = r"(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_ -]?key|access[_ -]?key|auth|bearer|credential|private[_ -]?key|client[_ -]?id)(?:[_-][A-Za-z0-9_-]{0,24})?[\"']?\s*(?:[:=]|=>|is)?\s*[\"']?$"
OTHER_WORDS = r"(?i)(?:sha-?(?:1|256|512)?|md5|commit|checksum|digest|uuid|guid|etag|hash|revision|integrity|build|isbn|order|invoice|phone|card)[\"']?\s*(?:[:=]|is)?\s*[\"']?$"
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?|xxxx|test|todo|redacted|12345678|abcdef"
ISSUED = r"^(?:AKIA|ASIA|ghp_|gho_|github_pat_|sk_live_|sk-|xox[abp]-|AIza|eyJ|glpat-|npm_)"
#: Frequent words of code and prose, as a dictionary for coverage.
WORDS = ("about", "access", "account", "action", "address", "admin", "after", "array", "base", "build", "button", "cache", "class", "client", "cloud", "code", "config", "content", "control", "count", "create", "data", "date", "default", "delete", "device", "document", "error", "event", "example", "field", "file", "filter", "form", "from", "group", "handler", "header", "home", "html", "http", "https", "image", "index", "input", "item", "java", "json", "label", "last", "line", "link", "list", "local", "login", "main", "manager", "message", "method", "model", "module", "name", "node", "number", "object", "option", "order", "output", "page", "param", "path", "post", "public", "query", "read", "report", "request", "response", "result", "route", "sample", "script", "search", "select", "server", "service", "session", "setting", "size", "source", "start", "state", "static", "status", "string", "style", "system", "table", "target", "test", "text", "time", "title", "type", "update", "user", "value", "version", "view", "with", "world", "write")
FEATURES = ("length", "changes", "kinds", "digits", "upper", "variety", "pairs", "covered", "known", "slashes", "path", "hex", "issued", "keyword", "other", "placeholder", "assigned", "quoted")
TREES, DEPTH, DICTIONARY, FINDINGS = 15, 6, 4096, 100_000


def dictionary(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY) -> list[str]:
    """The most frequent words of three letters or more, ties in order of the alphabet; of all texts, counted whole."""
    word = F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(r"\b[a-z]{3,24}\b"), F.lit(0)))
    counts = docs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]


def features(s: Column, words: list[str]) -> dict[str, Column]:
    """Of a candidate (start, end, text, before, after), with the dictionary of the texts."""
    text, n = s["text"], F.length(s["text"]).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]", "-"), "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A")
    lower = F.lower(text)
    share = lambda pattern: (n - F.length(F.regexp_replace(text, pattern, ""))) / n
    flag = lambda c: c.cast("double")
    return {
        "length": F.least(n, F.lit(120.0)),
        "changes": F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / n,
        "kinds": F.size(F.array_distinct(F.split(kinds, ""))).cast("double"),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "variety": F.size(F.array_distinct(F.split(text, ""))) / F.least(n, F.lit(64.0)),
        # letter pairs common in words: transitions that chance rarely makes
        "pairs": (n - F.length(F.regexp_replace(lower, "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce|li|ch|ll|be|ma|si|om|ur", ""))) / n,
        "covered": (n - F.length(F.regexp_replace(lower, "|".join(sorted(WORDS, key=len, reverse=True)), ""))) / n,
        # letters that stand in whole words of the dictionary
        "known": F.aggregate(F.filter(F.regexp_extract_all(lower, F.lit("[a-z]{3,}"), F.lit(0)), lambda w: w.isin(*words)) if words else F.array().cast("array<string>"), F.lit(0), lambda n, w: n + F.length(w)) / n,
        "slashes": n - F.length(F.regexp_replace(text, "[/_-]", "")),
        "path": flag(s["before"].rlike(r"(?:https?:|www\.|\./|[A-Za-z0-9]\.|://|/)[^\s]*$") | text.rlike(r"^/|[a-z]{3,}/[a-z]{3,}/")),
        "hex": flag(text.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
        "issued": flag(text.rlike(ISSUED)),
        "keyword": flag(s["before"].rlike(KEYWORDS)),
        "other": flag(s["before"].rlike(OTHER_WORDS)),
        "placeholder": flag(F.concat(text, F.lit(" "), F.right(s["before"], F.lit(12))).rlike(PLACEHOLDER)),
        "assigned": flag(s["before"].rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(s["before"].rlike(r"[\"']$") & s["after"].rlike(r"^[\"']")),
    }


def labelled_findings(n: int = 3000, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """``(text, before, after, secret)``: made findings of known kind, the default training set; bounded by ``n``."""
    r = random.Random(seed)
    some = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    alnum, hexa, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    syllables = ["an", "re", "tion", "er", "in", "th", "on", "st", "ing", "ou", "ly", "ha", "ble", "ä", "ment", "que", "ch", "en"]
    prose = lambda: " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(3)) + " "
    words = lambda: "".join(r.choice(WORDS) for _ in range(r.randint(3, 5)))
    named = ["token", "secret", "password", "api_key", "API-KEY", "access_key", "client_secret", "auth", "bearer", "passwd"]
    joins = [' = "', ": ", "=", ' => "', "='", ": '"]

    def true() -> tuple[str, str, str]:
        body = r.choice([lambda: some(hexa, r.choice([32, 40, 64])), lambda: some(alnum, r.randint(20, 44)), lambda: some(b64, r.choice([32, 40, 43])) + r.choice(["", "=", "=="]), lambda: r.choice(["AKIA", "ghp_", "sk_live_", "xoxb-", "glpat-"]) + some(alnum, r.randint(16, 36)), lambda: some(alnum + "!@#$%", r.randint(12, 20)), lambda: some(hexa[:10] + hexa[10:].upper(), r.choice([32, 40]))])()
        if body.startswith(("AKIA", "ghp_", "sk_live_", "xoxb-", "glpat-")) and r.random() < 0.5:
            return body, prose(), " " + prose()
        join = r.choice(joins)
        return body, prose() + r.choice(named) + join, ('"' if '"' in join else "'" if "'" in join else "") + " " + prose()

    def false() -> tuple[str, str, str]:
        kind = r.randint(0, 9)
        if kind == 0:
            return str(uuid.UUID(int=r.getrandbits(128))), prose() + r.choice(["uuid: ", "id=", "guid ", "request "]), " "
        if kind == 1:
            return some(hexa, r.choice([32, 40, 64])), prose() + r.choice(["commit ", "sha256: ", "md5 = ", "checksum: ", "etag: ", "revision "]), " "
        if kind == 2:
            return some(string.digits, r.randint(16, 24)), prose() + r.choice(["", "order ", "isbn ", "no. ", "card "]), " " + prose()
        if kind == 3:
            return "/".join(r.choice(WORDS) for _ in range(r.randint(3, 6))) + str(r.randint(1, 99)), prose() + r.choice(["https://www.", "path: ", "src=", "./"]), " "
        if kind == 4:
            return words() + str(r.randint(1, 2000)), prose() + r.choice(["class ", "call ", "key: ", "name = ", ""]), " "
        if kind == 5:
            return r.choice(["your_api_key_goes_here1", "xxxxxxxxxxxxxxxx0000", "changeme12345678", "example-token-12345", "test_secret_00000000", "REDACTED-00000000"]) + some("x01", r.randint(0, 4)), prose() + r.choice(named) + r.choice(joins), " "
        if kind == 6:
            return "".join(r.choice(syllables[:13]) for _ in range(r.randint(6, 10))) + str(r.randint(0, 9)), prose(), " " + prose()
        if kind == 7:
            return "-".join(r.choice(WORDS) for _ in range(r.randint(2, 5))) + "-" + str(r.randint(2000, 2030)), prose() + r.choice(["", "slug: ", "/"]), " "
        if kind == 8:
            return "".join(r.choice(syllables[:13]) for _ in range(r.randint(4, 7))), prose() + r.choice(["note: ", "name: ", "see: ", "x = "]), " " + prose()
        return some("-_=", 3) + some("0-", r.randint(16, 30)), prose(), " "

    return [(*(t := true() if i % 2 else false())[:1], t[1][-32:], t[2][:32], i % 2) for i in range(n)]


def train(findings: DataFrame, words: list[str], most: int = FINDINGS):
    """A forest over the features of labelled findings ``(text, before, after, label)``: at most ``most`` rows, those
    with the smallest hashes."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.select("text", "before", "after", F.col("label").cast("double").alias("label")).where("text is not null and label is not null")
    rows = rows.orderBy(F.xxhash64("text", "before", "after"), "text", "label").limit(most)
    s = F.struct("text", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"))
    table = rows.select("label", *[c.cast("double").alias(k) for k, c in features(s, words).items()]).coalesce(1)
    points = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=11, featureSubsetStrategy="onethird").fit(points)


def trees_of(model) -> list:
    """Nested (feature, threshold, left, right) with leaves as shares of the positive class."""

    def node(n):
        if n.numDescendants() == 0:
            stats = list(n.impurityStats().stats())
            return stats[1] / (stats[0] + stats[1])
        split = n.split()
        return (int(split.featureIndex()), float(split.threshold()), node(n.leftChild()), node(n.rightChild()))

    return [node(t._call_java("rootNode")) if not hasattr(t, "_java_obj") else node(t._java_obj.rootNode()) for t in model.trees]


def score(trees: list, values: list[Column]) -> Column:
    def walk(t) -> Column:
        return F.lit(round(t, 6)) if isinstance(t, float) else F.when(values[t[0]] <= t[1], walk(t[2])).otherwise(walk(t[3]))

    return functools.reduce(lambda a, b: a + b, map(walk, trees)) / len(trees)


def verdicts(docs: DataFrame, text_col: str, findings: DataFrame | None, least: float) -> Column:
    """Expression: the findings of ``text_col``, an array of (start, end, text, score, secret), in order."""
    spark = docs.sparkSession
    words = dictionary(docs, text_col)
    if findings is None:
        findings = spark.createDataFrame(labelled_findings(), "text string, before string, after string, label int")
    trees = trees_of(train(findings, words))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def measured(s: Column) -> Column:
        own = features(s, words)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.array(*[own[k].cast("double") for k in FEATURES]).alias("x"))

    def judged(m: Column) -> Column:
        p = score(trees, [F.element_at(m["x"], i + 1) for i in range(len(FEATURES))])
        sure = m["text"].startswith("-----BEGIN")
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.round(p, 4).alias("score"), (sure | (p >= least)).alias("secret"))

    return F.transform(F.transform(located(text, CANDIDATE), measured), judged)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """``(id, findings)`` per row: array of (start, end, text, score, secret), in order."""
    return docs.select(id_col, verdicts(docs, text_col, findings, least).alias("findings"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", findings: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """``docs`` with every secret replaced by ``mark``; other columns as they are."""
    found = verdicts(docs, text_col, findings, least)
    text = F.col(text_col)

    def cleaned(f: Column) -> Column:
        shown = F.transform(f, lambda x: F.when(x["secret"], F.lit(mark)).otherwise(x["text"]))
        parts = F.zip_with(F.split(text, CANDIDATE, -1), shown, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
        return F.when(F.exists(f, lambda x: x["secret"]), F.array_join(parts, "")).otherwise(text)

    return docs.withColumn(text_col, kept(found, cleaned))


def op4_secrets(spark, sf_dir: str) -> DataFrame:
    """One row per candidate, with the forest's verdict; the text of a finding is not returned."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    each = found.select("doc_id", F.explode("findings").alias("f"))
    return each.select("doc_id", F.col("f.start").cast("long").alias("start"), F.col("f.end").cast("long").alias("end"), F.sha2("f.text", 256).alias("finding_sha256"), F.col("f.score").alias("score"), F.col("f.secret").alias("secret"))
