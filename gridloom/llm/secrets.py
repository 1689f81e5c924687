"""Secret scans: candidate strings from a pattern, false positives removed by a random forest.

All in DataFrame expressions: texts are cut at candidates, each candidate gets features of its length, its character
transitions, the share of it that dictionary words cover, its path and the words beside it, and MLlib's random forest,
trained here on labelled findings, scores it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Group 1 and what follows it: a name with a key word, an assignment, and its value of any length and marks, quoted or
#: up to white space. Else a known prefix, three dotted base64 parts, or a run of key characters with a digit, long enough
#: to hold a key; "=" is part of such a run as padding only.
_KEY = r"(?=[SsTtPpAaCcBb])(?i:secret|token|passw|passphrase|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|signing[_ -]?key|credential|bearer|auth(?!or))"
_ASSIGNED = _KEY + r"[A-Za-z0-9_-]{0,24}[\"']?(?:\s{0,3}(?:[:=]=?>?)\s{0,3}|(?<=(?i:bearer))\s{1,3})"
_RUN = (
    r"(?<![A-Za-z0-9_+/-])((?:AKIA|ASIA)[A-Z0-9]{12,}|gh[opsru]_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{12,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{10,}"
    r"|eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
    r"|(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{16,}(?:={1,2}(?![A-Za-z0-9_+/=-]))?)"
)
CANDIDATE = (
    r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]{0,40}?" + _ASSIGNED + r"(?:(?i:bearer|basic|token)\s{1,3})?)"
    r"(?:(\")([^\"\n\x01]+)(?=\")|(')([^'\n\x01]+)(?=')|([^\s\"'\x01]+?)(?=[,.;)\]}]*(?:[\s\"']|$)))|" + _RUN
)
#: Cheaper: any text that holds a candidate.
_MAY_HOLD = _ASSIGNED + "|" + _RUN
_CUT = "$1$2$4\x01$3$5$6$7\x01"
BEFORE, AFTER = 48, 24
#: A finding at or above this share of trees is a secret.
THRESHOLD = 0.5
LABELLED = 6_000
#: Texts with secrets whose places are broadcast at most; more meet their texts by a shuffle.
BROADCAST_TEXTS = 100_000
TREES, DEPTH, SEED = 24, 7, 11

#: Words that random keys do not hold, and words beside keys or beside other long strings.
DICTIONARY = (
    "about above account after again ahead alpha apple array author backup bench beta bottom branch build cache change "
    "check class client code color commit common config count create daily data debug default delete demo detail device "
    "docs draft dummy error event example export false field file final first fixture flag folder format from group "
    "header hello here html image import index input item java json kernel label last latest library line list local "
    "login long main master merge message method middle minor mode model module month name network next node null "
    "number object open option order output page param parse patch path phase place plugin point port prefix print "
    "prod project public python query queue random read ready record release remote report request reset result right "
    "root route sample schema score script search section select series server service session setup shared simple "
    "size small snapshot source space spec stage start state static status step store string style suffix super system "
    "table target task temp test text that theme there this thread ticket time title todo tool total track train true "
    "type under unit update upload user value vendor version video view week where width with word work world write "
    "xxxx year your zero zone"
).split()
KEY_WORDS = r"(?i)(secret|token|passw|pwd|api[_ -]?key|apikey|access[_ -]?key|private|credential|bearer|auth|signing)"
OTHER_WORDS = r"(?i)(commit|revision|sha-?\d|md5|checksum|digest|hash|uuid|guid|etag|integrity|build|version|card|order|invoice|phone|call|isbn|serial|example|sample|placeholder|dummy|data:)"
PATH_OTHER = r"(?i)(test|spec|fixture|mock|example|sample|docs?/|lock|\.md$|\.min\.)"
PATH_KEYS = r"(?i)(\.env|\.pem|\.ya?ml$|\.ini$|\.cfg$|config|settings|deploy|secret|credential)"


def _share(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")) / F.length(text)


def features() -> dict[str, Column]:
    """Of columns candidate, before, after and path, none of them null."""
    c = F.col("candidate")
    pairs = F.greatest(F.length(c) - 1, F.lit(1))
    change = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    words = "(?i)(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"
    flag = lambda x: x.cast("double")
    return {
        "length": F.length(c).cast("double"),
        "digits": _share(c, "[^0-9]"),
        "upper": _share(c, "[^A-Z]"),
        "lower": _share(c, "[^a-z]"),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "class_changes": F.regexp_count(c, F.lit(change)) / pairs,
        "vowel_changes": F.regexp_count(F.lower(c), F.lit("(?<=[aeiou])(?=[b-df-hj-np-tv-z])|(?<=[b-df-hj-np-tv-z])(?=[aeiou])")) / pairs,
        "marks": _share(c, "[A-Za-z0-9]"),
        "spaces": _share(c, r"\S"),
        "wrapped": flag(c.rlike(r"^([<{\[(%$].*[>}\])%]|\$\w+)$|[(\[{]")),
        "repeats": F.regexp_count(c, F.lit(r"(.)(?=\1)")) / pairs,
        "covered": 1 - F.length(F.regexp_replace(c, words, "")) / F.length(c),
        "hex_only": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "digits_only": flag(c.rlike("^[0-9]+$")),
        "uuid": flag(c.rlike("(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")),
        "known_prefix": flag(c.rlike("^(AKIA|ASIA|gh[opsru]_|glpat-|xox[abprs]-|sk_live_|eyJ)")),
        "key_word": flag(F.col("before").rlike(KEY_WORDS)),
        "key_word_next": flag(F.col("before").rlike(KEY_WORDS + r"[\w-]{0,12}[\"']?\s{0,3}[:= ]{0,3}\s{0,3}[\"']?$")),
        "assigned": flag(F.col("before").rlike(r"[:=]\s{0,3}[\"']?$")),
        "quoted": flag(F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")),
        "other_word": flag(F.col("before").rlike(OTHER_WORDS)),
        "path_other": flag(F.col("path").rlike(PATH_OTHER)),
        "path_keys": flag(F.col("path").rlike(PATH_KEYS)),
    }


def candidates(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, start (characters before it), candidate, before, after, path.

    The text is cut once at its candidates, so a long text costs one pass; texts without one end at the first filter.
    """
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.translate(F.col(text), "\x01\x02", "  ").alias("t"), (F.coalesce(F.col(path), F.lit("")) if path else F.lit("")).alias("path"))
    parts = rows.where(F.col("t").rlike(_MAY_HOLD)).select("doc_id", "path", F.split(F.regexp_replace("t", CANDIDATE, _CUT), "\x01").alias("parts"))
    # parts alternate: text, candidate, text, ...; ends[k] is where part k ends
    ends = F.aggregate(
        "parts", F.array(F.lit(0)).cast("array<int>"), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p)))
    )
    spread = parts.where(F.size("parts") > 1).withColumn("ends", ends).select("doc_id", "path", "parts", "ends", F.explode(F.sequence(F.lit(1), F.size("parts") - 2, F.lit(2))).alias("k"))
    near = lambda *steps: F.concat(*[F.coalesce(F.get("parts", F.col("k") + x), F.lit("")) for x in steps])
    return spread.select(
        "doc_id",
        F.element_at("ends", F.col("k") + 1).cast("long").alias("start"),
        F.get("parts", F.col("k")).alias("candidate"),
        F.right(near(-3, -2, -1), F.lit(BEFORE)).alias("before"),
        F.left(near(1, 2, 3), F.lit(AFTER)).alias("after"),
        "path",
    )


def labelled_findings(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """Reviewed findings to train on: candidate, before, after, path, label. ``rows`` texts made from a rule, alike in
    every run, and what ``candidates`` finds in them; a site with reviews of its own hands those to ``train`` instead."""
    h = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    made = spark.range(rows)

    def named(label: str, column: Column) -> Column:
        """A column of its own, so that the generated code holds it once."""
        nonlocal made
        made = made.withColumn(label, column)
        return F.col(label)

    b64 = named("b64", F.translate(F.base64(F.unhex(h("b"))), "=", ""))
    pick = lambda salt, *names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(names))) + 1).cast("int"))
    word = lambda salt: pick(salt, *DICTIONARY)
    prose = named("prose", F.concat(word("p1"), F.lit(" "), word("p2"), F.lit(", "), word("p3"), F.lit(" ")))
    digits = named("digits", F.translate(F.substring(h("d"), 1, 16), "abcdef", "012345"))
    name = named("name", pick("n", "token", "secret", "api_key", "password", "AUTH_TOKEN", "access_key", "client_secret", "apiKey", "private_key", "bearer"))
    join = named("join", pick("j", ' = "', '="', ": ", "=", ' = ', '": "', ": '", " "))
    end = named("end", F.when(join.contains('"'), F.lit('" ')).when(join.contains("'"), F.lit("' ")).otherwise(F.lit(" ")))
    other = pick("o", "commit ", "sha256: ", "md5 = ", "checksum: ", "digest=", "revision ", "etag: \"", "uuid: ", "build ", "integrity=\"")
    hexes = F.substring(h("x"), 1, F.element_at(F.array(F.lit(32), F.lit(40), F.lit(64), F.lit(24)), (F.pmod(F.xxhash64(F.lit("len"), "id"), F.lit(4)) + 1).cast("int")))
    keyed = named("keyed", F.concat(prose, name, join))
    size = lambda salt, low, high: (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(high - low + 1)) + low).cast("int")
    assign = named("assign", pick("g", ' = "', '="', ": ", "=", '": "', ": '"))
    stop = named("stop", F.when(assign.contains('"'), F.lit('" ')).when(assign.contains("'"), F.lit("' ")).otherwise(F.lit(" ")))
    given = named("given", F.concat(prose, name, assign))
    letters = named("letters", F.translate(h("a"), "0123456789abcdef", "QWXYZKLMPRABCDEF"))
    cases = [
        (hexes, keyed, end, 1),
        (F.left(b64, F.lit(40)), keyed, end, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(F.translate(h("a"), "0189", "QWXY"), 1, 15)), F.lit("7")), prose, F.lit(" "), 1),
        (F.concat(F.lit("ghp_"), F.left(F.translate(b64, "+/", "aB"), F.lit(36))), prose, F.lit(" "), 1),
        (F.concat(F.lit("eyJ"), F.left(b64, F.lit(17)), F.lit("."), F.substring(h("k"), 1, 30), F.lit("."), F.substring(h("l"), 1, 20)), keyed, end, 1),
        (F.concat(F.translate(F.substring(h("q"), 1, 14), "0123", "!KmZ"), F.lit("9xQ2")), keyed, end, 1),
        (F.substring(h("c"), 1, 40), F.concat(prose, other), F.lit(" "), 0),
        (h("s"), F.concat(prose, other), F.lit(" "), 0),
        (F.md5(h("m")), F.concat(prose, other), F.lit(" "), 0),
        (F.regexp_replace(F.substring(h("u"), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.concat(prose, pick("v", "", "id ", "uuid: ", "id=\"")), F.lit(" "), 0),
        (digits, prose, F.lit(" "), 0),
        (digits, F.concat(prose, pick("w", "card ", "order ", "invoice: ", "call ", "id = ")), F.lit(" "), 0),
        (F.concat(word("a1"), F.lit("_"), word("a2"), F.lit("-"), word("a3"), F.pmod("id", F.lit(97))), F.concat(prose, pick("y", "", "see ", 'name = "', "file: ")), F.lit(" "), 0),
        (F.concat(F.lit("your_"), word("a4"), F.lit("_"), word("a5"), F.lit("_here_"), F.pmod("id", F.lit(10))), keyed, end, 0),
        (F.concat(F.lit("x" * 16), F.pmod("id", F.lit(1000))), keyed, end, 0),
        (F.concat(word("a6"), F.lit("/"), word("a7"), F.lit("/"), word("a8"), F.lit("/v"), F.pmod("id", F.lit(40))), F.concat(prose, pick("z", "", "path ", "import ", "token from ")), F.lit(" "), 0),
        (F.concat(F.lit("AKIA"), F.substring(letters, 1, 16)), F.concat(prose, pick("i", "", "key ", "id=", "use ")), F.lit(" "), 1),
        (F.translate(F.substring(F.translate(b64, "+/", "!@"), F.lit(1), size("s1", 6, 15)), "AbCd", "!$%#"), given, stop, 1),
        (F.concat(F.initcap(word("b1")), pick("b2", "", "_", "-", "!", "@"), F.substring(digits, F.lit(1), size("s2", 2, 4)), pick("b3", "!", "$", "#", "%!", "")), given, stop, 1),
        (F.translate(F.substring(b64, F.lit(3), size("s3", 8, 15)), "+/", "xY"), given, stop, 1),
        (F.concat(F.lit("eyJ"), F.substring(b64, F.lit(1), size("s4", 3, 12)), F.lit("."), F.substring(h("k"), F.lit(1), size("s5", 4, 14)), F.lit("."), F.substring(h("l"), F.lit(1), size("s6", 4, 14))), F.concat(prose, pick("j1", "", "TOKEN=", "token: ", "use ")), F.lit(" "), 1),
        (F.concat(F.left(b64, F.lit(40)), pick("e", "=", "==")), given, stop, 1),
        (word("c1"), given, stop, 0),
        (F.concat_ws(" ", word("c2"), word("c3"), word("c4")), F.concat(prose, name, pick("g2", ": ", " = ", ": \"")), F.lit(" "), 0),
        (pick("c5", "None", "null", "true", "false", "required", "optional", "string", "changeme", "***", "undefined", "str,"), given, stop, 0),
        (F.concat(pick("c6", "${", "<", "{{", "os.environ[", "getenv(", "%("), F.upper(word("c7")), F.lit("_"), F.upper(name), pick("c8", "}", ">", "}}", "]", ")")), given, stop, 0),
        (F.substring(digits, F.lit(1), size("s7", 1, 5)), F.concat(prose, pick("c9", "max_tokens = ", "tokens: ", "n_tokens=", "token_count: ", "password_length = ")), F.lit(" "), 0),
        (F.concat(word("d1"), F.lit("."), word("d2"), pick("d3", "()", "", ".json", "_" )), given, stop, 0),
    ]
    kind = F.pmod("id", F.lit(len(cases)))
    chosen = reduce(lambda acc, kv: acc.when(kind == kv[0], F.struct(kv[1][0].alias("candidate"), kv[1][1].alias("before"), kv[1][2].alias("after"), F.lit(kv[1][3]).alias("label"))), enumerate(cases), F)
    label = F.col("f.label")
    path = F.when(label == 1, pick("pa", "", "src0", "app/config.py", ".env", "deploy/values.yaml", "lib/client.js")).otherwise(
        pick("pb", "", "src0", "tests/test_api.py", "docs/usage.md", "package-lock.json", "lib/client.js", "examples/demo.py")
    )
    made = made.withColumn("f", chosen).select("id", F.concat("f.before", "f.candidate", "f.after", word("p4")).alias("text"), path.alias("source"), label.alias("label"), F.length("f.before").alias("at"), F.length("f.candidate").alias("size"))
    made = common.shared_table(made, "labelled")
    found = candidates(made, "id").join(made.select(F.col("id").alias("doc_id"), "label", "at", "size"), "doc_id")
    inside = (F.col("start") < F.col("at") + F.col("size")) & (F.col("start") + F.length("candidate") > F.col("at"))
    return common.shared_table(found.select("candidate", "before", "after", "path", F.when(inside, F.col("label")).otherwise(0).cast("double").alias("label")), "findings")


def _vectors(df: DataFrame) -> DataFrame:
    wide = df.withColumns({f"f_{k}": v for k, v in features().items()})
    return VectorAssembler(inputCols=[f"f_{k}" for k in features()], outputCol="features").transform(wide)


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> RandomForestClassificationModel:
    """A forest on labelled findings, of which ``LABELLED`` rows are enough: columns candidate, before, after, path, label."""
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=SEED, maxBins=32)
    return forest.fit(_vectors(labelled).select("features", "label").repartition(4, "label"))


def scan(df: DataFrame, model: RandomForestClassificationModel, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, start, length, candidate, before, score (share of the forest), secret.

    Null and empty texts have no candidates; a null path counts as none. Repeated rows give their findings again. Only
    key, text and path are read.
    """
    scored = model.transform(_vectors(candidates(df, key, text, path)))
    score = vector_to_array("probability")[1]
    return scored.select("doc_id", "start", F.length("candidate").cast("long").alias("length"), "candidate", "before", score.alias("score"), (score >= THRESHOLD).alias("secret"))


def redact(df: DataFrame, model: RandomForestClassificationModel, key: str = "doc_id", text: str = "text", path: str | None = "source", mark: str = "[SECRET]", length: str = "n_chars") -> DataFrame:
    """``df`` with each secret replaced by ``mark`` and every column kept; a column ``length`` follows the text. Texts
    are told apart by key and hash, so rows that share a key, or have none, are redacted each by its own findings. Only
    the findings travel: where they are few enough to broadcast, no text is shuffled."""
    told = F.xxhash64(F.col(key), F.xxhash64(F.col(text)))
    found = scan(df.select(told.alias("doc_id"), F.col(text).alias("text"), (F.col(path) if path else F.lit("")).alias("source")), model).where("secret")
    name, at = common.unused(df, "__key"), common.unused(df, "__spans")
    spans = found.groupBy(F.col("doc_id").alias(name)).agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias(at))
    joined = df.join(common.bounded(common.shared_table(spans, "spans"), BROADCAST_TEXTS), told == F.col(name), "left")
    whole = F.aggregate(
        at,
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(F.concat(acc["done"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)).alias("done"), (s["start"] + s["length"]).alias("at")),
        lambda acc: F.concat(acc["done"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(text))),
    )
    new = F.when(F.col(at).isNull(), F.col(text)).otherwise(whole)
    if length in df.columns:
        joined = joined.withColumn(length, F.when(F.col(at).isNull(), F.col(length)).otherwise(F.length(whole).cast(df.schema[length].dataType)))
    return joined.withColumn(text, new).select(*df.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with a digest instead of the string itself, so that the report spreads no secrets."""
    found = scan(common.documents(spark, sf_dir), train(labelled_findings(spark)))
    return found.select("doc_id", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), F.round("score", 6).alias("score"), "secret")
