"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are of three kinds, without an upper bound on their length: values
assigned to a name that holds a word like "token" or "password" (six characters
or more of any kind but white space, quotes and angle brackets), private keys
between their PEM lines, and runs of 16 or more key characters that hold a
digit. Their features are SQL expressions: length, shares of character kinds,
transitions between kinds, distinct characters and entropy, how much of the
candidate words of a public vocabulary and common syllables cover, what the path
says, and which words stand before and after. A random forest of Spark's own ML
library, trained on labelled findings, gives each a probability.

Features and scores are DataFrame functions throughout; a text's candidates are
made in its row and nothing shuffles. Findings carry a digest of the secret and
not the secret.

Defined cases: null texts and texts without candidates have no findings; a null
path has path features 0; ids may be null or repeat; an empty table gives no
findings; training findings of a single label give every candidate that label.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table

SECRET_WORDS = r"(?i)(?:api[_-]?key|secret|token|passw(?:or)?d|passphrase|pwd|credential|auth|bearer|private[_-]?key|access[_-]?key)"
#: What leads to an assigned value: a name with such a word, and the sign of assignment.
ASSIGNED = r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]{0,40}?" + SECRET_WORDS.replace("(?i)(?:", "(?i:") + r"[A-Za-z0-9_.-]{0,16}[\"'`]?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"'`]?"
VALUE = r"[^\s\"'`<>]{6,}"
PEM = r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+(?:-----END (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----)?"
#: A run of 16 key characters or more, not within a longer run, with a digit in it.
RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}"
CANDIDATE = f"{ASSIGNED}{VALUE}|{PEM}|{RUN}"
OTHER_WORDS = r"(?i)(?:commit|sha-?(?:1|256)|md5|checksum|digest|hash|uuid|guid|revision|etag|isbn|order|invoice|tracking|card|phone|version|build)"
SAMPLE_WORDS = r"(?i)(?:example|sample|dummy|placeholder|changeme|your[_-]|xxxx|fake|redacted|test)"
KNOWN_PREFIX = r"^(?:-----BEGIN|AKIA|ASIA|AIza|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk-|SG\.|eyJ|ya29)"
#: Common words and syllables; what they cover is probably not random.
PIECES = r"(?i)(?:the|and|ing|tion|ent|for|that|with|this|from|pass|word|user|name|test|data|file|http|www|com|org|key|value|index|table|page|image|order|number|date|time|message|account|server|client|config|service)"
#: Lengths of the dictionary's words, and how many of them are used.
WORD_LENGTHS, WORDS = (4, 5, 6, 7, 8), 6000
BEFORE, AFTER = 48, 32
FEATURES = (
    "f_length", "f_digits", "f_upper", "f_lower", "f_symbols", "f_kind_changes", "f_case_changes", "f_distinct", "f_entropy", "f_repeats", "f_words", "f_dictionary", "f_sentence_words", "f_vowel_runs",
    "f_all_digits", "f_all_hex", "f_uuid", "f_prefix", "f_secret_before", "f_other_before", "f_sample_near", "f_sample_inside", "f_assigned", "f_quoted", "f_sentence_after",
    "f_path_test", "f_path_config",
)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """A row for each candidate: id, start (characters), value, before, after, path."""
    text = F.col(text_col)
    gaps, found = F.split(text, F.lit(CANDIDATE)), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    # what leads to an assigned value belongs to the words before it
    lead = lambda v: F.length(F.regexp_extract(v, "^" + ASSIGNED + f"(?={VALUE}$)", 0))
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).cast("bigint").alias("gap"), F.length(m).cast("bigint").alias("size"), lead(m).cast("bigint").alias("lead"), m.alias("value")))
    # each place is the sum of what lies before it
    walk = F.aggregate(
        steps,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,value:string>>").alias("out")),
        lambda a, s: F.struct((a["at"] + s["gap"] + s["size"]).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + s["gap"] + s["lead"]).alias("start"), F.substring(s["value"], (s["lead"] + 1).cast("int"), (s["size"] - s["lead"]).cast("int")).alias("value")))).alias("out")),
    )
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    with_any = docs.where(F.regexp_like(text, F.lit(CANDIDATE)))
    out = with_any.select(F.col(id_col).alias("_id"), text.alias("_text"), path.alias("path"), F.inline(walk["out"]))
    return out.select(
        F.col("_id").alias(id_col),
        "start",
        "value",
        F.substring("_text", F.greatest(F.lit(1), F.col("start") + 1 - BEFORE).cast("int"), F.least(F.lit(BEFORE), F.col("start")).cast("int")).alias("before"),
        F.substring("_text", (F.col("start") + 1 + F.length("value")).cast("int"), F.lit(AFTER)).alias("after"),
        "path",
    )


def dictionary(n: int = WORDS) -> list[str]:
    """The first n whole words of plain letters in the public vocabulary, which lists merges of frequent words first."""
    import json

    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    words = (t[:-4] for t, _ in sorted(ids.items(), key=lambda x: x[1]) if t.endswith("</w>"))
    return [w for w in words if len(w) in WORD_LENGTHS and w.isascii() and w.isalpha()][:n]


def _word_ends(column: str) -> Column:
    """At how many places of the column a word of the dictionary ends. One walk that holds the last letters; the list is looked up by hash."""
    words, most = ", ".join(f"'{w}'" for w in dictionary()), max(WORD_LENGTHS)
    last = f"right(concat(a.last, c), {most})"
    ends = f"exists(array({', '.join(map(str, WORD_LENGTHS))}), n -> right({last}, n) IN ({words}))"
    return F.expr(f"aggregate(split(lower({column}), ''), struct('' AS last, 0 AS n), (a, c) -> struct({last} AS last, a.n + if({ends}, 1, 0) AS n), a -> a.n)").cast("double")


def features(found: DataFrame) -> DataFrame:
    """found (value, before, after, path) with the FEATURES as doubles."""
    v, n = F.col("value"), F.length("value").cast("double")
    count = lambda p: F.regexp_count(v, F.lit(p)).cast("double")
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    like = lambda c, p: flag(F.regexp_like(c, F.lit(p)))
    letters = F.filter(F.split(v, ""), lambda c: F.length(c) > 0)
    distinct = F.array_distinct(letters)
    entropy = F.aggregate(
        F.transform(distinct, lambda c: (n - F.length(F.replace(v, c, F.lit("")))) / n),
        F.lit(0.0),
        lambda a, p: a - p * F.log2(p),
    )
    columns = {
        "f_length": n,
        "f_digits": count("[0-9]") / n,
        "f_upper": count("[A-Z]") / n,
        "f_lower": count("[a-z]") / n,
        "f_symbols": count("[^A-Za-z0-9]") / n,
        "f_kind_changes": count("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])") / n,
        "f_case_changes": count("[a-z](?=[A-Z])|[A-Z](?=[a-z])") / n,
        "f_distinct": F.size(distinct).cast("double") / n,
        "f_entropy": entropy,
        "f_repeats": count(r"(.)(?=\1)") / n,
        "f_words": (n - F.length(F.regexp_replace(v, PIECES, ""))) / n,
        "f_dictionary": _word_ends("value") / n,
        "f_sentence_words": F.size(F.regexp_extract_all(v, F.lit("[a-z]+(?=[^A-Za-z0-9]|$)"), F.lit(0))).cast("double") / n,
        "f_vowel_runs": count("(?i)[bcdfghjklmnpqrstvwxyz][aeiou]") / n,
        "f_all_digits": like(v, "^[0-9]+$"),
        "f_all_hex": like(v, "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        "f_uuid": like(v, "^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"),
        "f_prefix": like(v, KNOWN_PREFIX),
        "f_secret_before": like(F.col("before"), SECRET_WORDS + r"[\w.-]{0,16}\W{0,6}\w{0,12}\W{0,6}$"),
        "f_other_before": like(F.col("before"), OTHER_WORDS),
        "f_sample_near": like(F.concat("before", F.lit(" "), "after"), SAMPLE_WORDS),
        "f_sample_inside": like(v, SAMPLE_WORDS),
        "f_assigned": like(F.col("before"), r"[:=]\s*[\"']?$"),
        "f_quoted": like(F.col("before"), "[\"'`]$"),
        "f_sentence_after": like(F.col("after"), r"^[\"'`]?\s+[a-z]"),
        "f_path_test": like(F.col("path"), r"(?i)(?:test|example|sample|fixture|mock|docs?/)"),
        "f_path_config": like(F.col("path"), r"(?i)(?:\.env|config|settings|credential|\.ya?ml|\.properties|\.ini)"),
    }
    return found.withColumns(columns)


def labelled_findings(spark: SparkSession, rows: int = 4000, seed: int = 11) -> DataFrame:
    """Findings with known labels, made by rule: keys of public formats in contexts that hold keys, and look-alikes.

    rows bounds the table; the digits come from SHA-256 of the row's number.
    """
    hexa = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(hexa)), "=+$", "")
    upper = F.translate(F.upper(hexa), "0189", "XKQZ")
    digits = F.translate(hexa, "abcdef", "493817")
    cut = lambda c, n: F.substring(c, 1, n)
    word = lambda k: F.element_at(F.array(*map(F.lit, ("erthing", "with the", "onenth", "value of", "de la", "und der", "as", "file"))), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(8)) + 1).cast("int"))
    pick = lambda k, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
    prose_b, prose_a = F.concat(word(1), F.lit(" "), word(2), F.lit(" ")), F.concat(F.lit(" "), word(3), F.lit(" "), word(4))
    kinds = [
        (1, F.concat(F.lit("AKIA"), cut(upper, 16)), prose_b, prose_a),
        (1, F.substring(hexa, 1, 18), F.concat(prose_b, pick(5, "password=", "passwd: ", "pwd=", "db_password=")), prose_a),
        (1, cut(hexa, 40), F.concat(prose_b, pick(6, 'token = "', "auth_token: ", 'api_key="', "secret='", "access_key=")), F.concat(F.lit('"'), prose_a)),
        (1, F.concat(F.lit("ghp_"), cut(b64, 36)), F.concat(prose_b, pick(7, "", "token=", "Bearer ")), prose_a),
        (1, cut(b64, 40), F.concat(prose_b, pick(8, "aws_secret_access_key = ", "client_secret=", "apikey: ", "SECRET=")), prose_a),
        (1, F.concat(pick(9, "sk_live_", "sk-", "glpat-", "xoxb-"), cut(b64, 28)), prose_b, prose_a),
        (1, F.concat(pick(18, "correcthorse", "ilovemydog", "summerrain", "Tr0ub4dor", "openSesame", "letmeinplease"), pick(19, "battery", "garden", "winter", "!river", "mountain"), pick(20, "staple", "window", "#9", "yellow", "")), F.concat(prose_b, pick(21, "password: ", "password=", "passwd = '", "pwd: ", "passphrase=")), prose_a),
        (1, F.concat(pick(22, "hunter", "qwerty", "dragon", "zx!", "P@ss", "m0nkey"), cut(digits, 3), pick(23, "!", "", "#", "$x")), F.concat(prose_b, pick(24, "password=", "db_password: ", "pwd=", 'secret="')), prose_a),
        (1, F.translate(cut(b64, 24), "0123456789+/", "abcdefghijkl"), F.concat(prose_b, pick(25, "api_key=", "token: ", 'access_key="', "auth_token=")), prose_a),
        (1, F.concat(F.lit("-----BEGIN "), pick(26, "RSA ", "", "EC ", "OPENSSH "), F.lit("PRIVATE KEY-----\n"), b64, F.lit("\n"), b64, F.lit("\n")), prose_b, prose_a),
        (1, F.concat(b64, b64, b64, b64, b64, b64, b64, b64, b64, b64, b64, b64, b64, b64), F.concat(prose_b, pick(27, "token=", "", "Bearer ")), prose_a),
        (0, pick(28, "required", "string", "undefined", "request.form", "getpass()", "os.environ", "optional,", "none,", "settings.token", "is", "the", "must be", "process.env.TOKEN", "${TOKEN}", "[hidden]", "******", "forgotten?"), F.concat(prose_b, pick(29, "password: ", "token: ", "secret = ", "auth = ", "api_key=", "credential: ")), prose_a),
        (0, F.concat(prose_b, pick(30, "information", "authentication", "application")), F.concat(pick(31, "token: ", "secret: ", "password: "), F.lit("")), prose_a),
        (0, cut(digits, 16), prose_b, prose_a),
        (0, F.concat(F.lit("4"), F.substring(digits, 1, 15)), F.concat(prose_b, pick(10, "", "card ", "order ", "invoice no. ")), prose_a),
        (0, cut(hexa, 40), F.concat(prose_b, pick(11, "commit ", "revision ", "sha1 ", "tree ")), prose_a),
        (0, hexa, F.concat(prose_b, pick(12, "sha256:", "checksum ", "digest: ", "etag ")), prose_a),
        (0, F.concat_ws("-", F.substring(hexa, 1, 8), F.substring(hexa, 9, 4), F.substring(hexa, 13, 4), F.substring(hexa, 17, 4), F.substring(hexa, 21, 12)), F.concat(prose_b, pick(13, "uuid ", "id=", "guid: ", "")), prose_a),
        (0, F.concat(pick(14, "AKIAEXAMPLE", "your-api-key-", "changeme-", "xxxxxxxxxxxx", "dummy_token_"), cut(digits, 8)), F.concat(prose_b, pick(15, "token=", "password=", "key: ")), prose_a),
        (0, F.concat(pick(16, "the-release-version-", "order_confirmation_", "image_gallery_page", "/files/data/index/table", "internationalization"), cut(digits, 4)), prose_b, prose_a),
        (0, F.concat(F.lit("2024-01-0"), cut(digits, 1), F.lit("T00-00-"), F.substring(digits, 2, 2)), prose_b, prose_a),
    ]
    kind = F.pmod("id", F.lit(len(kinds)))
    choose = lambda i: F.coalesce(*[F.when(kind == k, x[i] if i else F.lit(x[0])) for k, x in enumerate(kinds)])
    return spark.range(rows).select(
        choose(0).cast("double").alias("label"),
        choose(1).alias("value"),
        choose(2).alias("before"),
        choose(3).alias("after"),
        pick(17, "src1", "src2", "src3", "app/config/settings.py", ".env", "lib/main.go", "tests/fixtures/a.json", "docs/example.md").alias("path"),
    )


def train(findings: DataFrame, trees: int = 24, depth: int = 8, seed: int = 5) -> RandomForestClassificationModel:
    """findings: value, before, after, path, label (0 or 1)."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(findings)).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label").fit(rows)


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """A row for each candidate: id, start, length, secret_sha256, score, is_secret."""
    found = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(features(candidates(docs, id_col, text_col, path_col)))
    scored = model.transform(found)
    p = vector_to_array("probability")
    score = p[1] if model.numClasses > 1 else F.lit(0.0)
    return scored.select(id_col, "start", F.length("value").cast("bigint").alias("length"), F.sha2(F.col("value").cast("binary"), 256).alias("secret_sha256"), score.alias("score"), (score >= threshold).alias("is_secret"))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return scan(docs, train(labelled_findings(spark))).where("is_secret").select("doc_id", "start", "length", "secret_sha256", "score")
