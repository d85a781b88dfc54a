"""Secret scans with a random forest that removes false positives, in DataFrame functions only.

A candidate is a run of 16 or more characters of [A-Za-z0-9+/_-] with a digit in it, a token of three
dotted parts, a PEM header, the password of a URL, or, where an assignment or a credential word comes before, any value of 8
or more characters. Features tell of
its length, the transitions between its characters (how probable they are in the words of a public
vocabulary, and between kinds of characters), how much of it a dictionary and that vocabulary cover, its path (its
own, and where the document is from) and the words beside it. A forest is trained from labelled
findings and judges every candidate.
"""

from __future__ import annotations

import functools
import json
import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST = 16
CANDIDATE = "[A-Za-z0-9+/_-]{16,}"
DOTTED = "[A-Za-z0-9_-]{2,}[.][A-Za-z0-9_-]{6,}[.][A-Za-z0-9_-]{16,}"
PEM = "-----BEGIN [A-Z0-9 ]+-----"
#: An assigned value, alone or behind its name and sign: in quotes all between them, else up to the closing marks.
ASSIGNED = "^[\"'`]?[A-Za-z0-9_.-]*[\"'`]?[=:]+([^=:/].*)$"
SHORT = 8
#: Labelled findings to train on: the bound of the generated ones, and of given ones (the first by hash).
TRAINING_ROWS = 6000
TREES, DEPTH, SEED = 24, 8, 7
#: Words that names and placeholders are made of, and secrets are not (fixed values).
DICTIONARY = (
    "access account admin alpha attention batch beta block branch bucket build cache change class client cluster code color config count "
    "customer data date default demo device docs dummy error event example fake feature field file filter final format gamma group guide "
    "handler hash header height hello image import index input item label layer length level library light limit list local lorem main "
    "manager message method model module name node number object option order output package page param path phase placeholder point "
    "policy process product project public query queue random range record release remote report request response result sample schema "
    "secret section select server service session size source spark stage start state status step stream string style summary switch "
    "system table target task template test text theme thread time title token trace type unit update user value version view vector "
    "weight width window word world write your"
).split()
#: Words beside a candidate that speak for a secret, and against one (fixed values).
KEY_WORDS = "token|secret|passw|passwd|pwd|api|apikey|key|auth|authorization|bearer|credential|private|access"
OTHER_WORDS = "commit|sha|sha1|sha256|md5|hash|checksum|digest|uuid|guid|etag|revision|version|build|isbn|phone|card|account|invoice|order|url|file|path|image"
#: What providers put before their keys.
PREFIX = "^(AKIA|ASIA|AIza|gh[oprsu]_|glpat-|npm_|sk_live_|xox[abp]-)"
#: The password of a URL's credentials.
CREDENTIALS = "[A-Za-z][A-Za-z0-9+.-]*://[^/:@]*:([^/@]+)@"
FEATURES = (
    "length distinct_share transition_share bigrams vocabulary in_url digit_share upper_share hex alternating covered slashes dots numeric dashes path_word "
    "key_before other_before key_near assigned quoted words_around prefix"
).split()


@functools.cache
def public_words(path: str) -> tuple[str, ...]:
    """The whole words of a public sentencepiece vocabulary: pieces of four letters a-z or more that begin a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(k) for k in range(model.get_piece_size())}
    return tuple(sorted({w for p in found if p[0] == "\u2581" and len(w := p[1:].lower()) >= 4 and w.isascii() and w.isalpha()}))


@functools.cache
def bigram_table(path: str) -> tuple[float, ...]:
    """log2 of the probability of each letter after another in the words of the vocabulary, 27 by 27; 0 stands for no letter."""
    counts = [[1.0] * 27 for _ in range(27)]
    for word in public_words(path):
        codes = [0, *(ord(c) - 96 for c in word), 0]
        for a, b in zip(codes, codes[1:]):
            counts[a][b] += 1
    return tuple(round(math.log2(n / sum(row)), 4) for row in counts for n in row)


def _array(values: tuple, kind: str) -> Column:
    """A constant array, as one literal."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def mean_bigram(text: Column, path: str) -> Column:
    """The mean log2 probability of the transitions between neighbouring characters; 0 for a single one."""
    codes = F.transform(F.split(F.lower(text), ""), lambda c: F.when(c.rlike("^[a-z]$"), F.ascii(c) - 96).otherwise(0))

    def mean(own: Column) -> Column:
        steps = F.transform(F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))), lambda b, i: F.get(_array(bigram_table(path), "double"), 27 * F.get(own, i) + b))
        return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(own) - 1, F.lit(1))

    return F.get(F.transform(F.array(codes), mean), F.lit(0))


def known_share(text: Column, path: str) -> Column:
    """The share of characters in words of the vocabulary, as capitals and other characters part them."""
    parts = F.transform(F.regexp_extract_all(text, F.lit("([A-Z]?[a-z]{3,}|[A-Z]{4,})"), 1), F.lower)
    # A list of constants is one hash set for all rows.
    known = F.filter(parts, lambda w: w.isin(list(public_words(path))))
    return F.aggregate(known, F.lit(0), lambda a, w: a + F.length(w)) / F.greatest(F.length(text), F.lit(1))


def candidates(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text", path: str | None = "source") -> DataFrame:
    """keys, word_no (from 0), nth (candidate of that word), value, path, word, before2, before1 and after1.

    Words are runs of non-white space of the whole text. A null or blank text has no candidate.
    """
    words = F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+")
    where = F.col(path).cast("string") if path else F.lit(None).cast("string")
    key = f"(^|[^a-z])({KEY_WORDS})"

    def look(w: Column, i: Column) -> Column:
        near = [F.when(i + k >= 0, F.get(F.col("words"), i + k)).alias(n) for n, k in (("before2", -2), ("before1", -1), ("after1", 1))]
        ahead = F.when(w.endswith("-----BEGIN"), F.concat_ws(" ", *[F.get(F.col("words"), i + k) for k in range(5)])).alias("ahead")
        # Only words that can hold a candidate get their neighbours: the others are null here.
        before, earlier = F.lower(F.get(F.col("words"), F.greatest(i - 1, F.lit(0)))), F.lower(F.get(F.col("words"), F.greatest(i - 2, F.lit(0))))
        may = (F.length(w) >= SHORT) & ((F.length(w) >= LEAST) | w.rlike("[=:]|-----BEGIN$") | before.rlike(f"[=:]$|{key}") | before.isin("is", "was") & earlier.rlike(key))
        return F.when(may, F.struct(i.alias("word_no"), w.alias("word"), *near, ahead))

    listed = docs.select(*keys, where.alias("path"), words.alias("words"))
    few = F.filter(F.transform("words", look), lambda x: x.isNotNull())
    near = listed.select(*keys, "path", F.explode(few).alias("w")).select(*keys, "path", "w.*")
    beside = ("before2", "before1", "after1")
    signed = F.col("before1").rlike("[=:]$") | F.col("before1").isin("is", "was") & F.lower("before2").rlike(key)
    told = F.coalesce(signed | F.lower("before1").rlike(key), F.lit(False)) & ~F.col("word").contains("-----")
    inside = F.regexp_extract("word", ASSIGNED, 1)
    url = F.regexp_extract("word", CREDENTIALS, 1)
    given = F.when(url != "", "").when(inside != "", inside).when(told, F.col("word")).otherwise(F.lit(""))
    quoted = F.regexp_extract(given, "^([\"'`])(.*)\\1", 2)
    given = F.when(quoted != "", quoted).otherwise(F.regexp_replace(given, "^[\"'`(\\[{<]+|[^A-Za-z0-9=!@$%^&*+/_-]+$", ""))
    runs = F.filter(F.regexp_extract_all("word", F.lit(f"({CANDIDATE})"), 1), lambda x: x.rlike("[0-9]"))
    dotted = F.filter(F.regexp_extract_all("word", F.lit(f"({DOTTED})"), 1), lambda x: x.rlike("[0-9]"))
    pem = F.when(F.col("word").rlike("-----BEGIN$"), F.regexp_extract("ahead", f"({PEM})", 1)).otherwise(F.lit(""))
    listed = F.filter(F.array_distinct(F.concat(runs, dotted, F.array(given, pem, url))), lambda x: F.length(x) >= SHORT)
    near = near.select(*keys, "path", "word_no", "word", *beside, listed.alias("listed")).where(F.size("listed") > 0)
    # A part of a longer value is no candidate of its own.
    whole = F.filter("listed", lambda x: ~F.exists("listed", lambda y: (y != x) & F.contains(y, x)))
    return near.select(*keys, "word_no", F.posexplode(whole).alias("nth", "value"), "path", "word", *beside).select(*keys, "word_no", "nth", "value", "path", "word", *beside)


def features(found: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """found with a double for each of FEATURES. vocabulary names a public sentencepiece file, the 32k one if it is left out."""
    vocabulary = vocabulary or default_vocabulary()
    value, low, n = F.col("value"), F.lower("value"), F.length("value").cast("double")
    before = F.lower(F.concat_ws(" ", "before2", "before1"))
    around = F.lower(F.concat_ws(" ", "before2", "before1", F.replace(F.col("word"), value, F.lit(" ")), "after1"))

    def has(text: Column, words: str) -> Column:
        return text.rlike(f"(^|[^a-z])({words})").cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)) / n

    runs = F.regexp_count(value, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"))
    covered = F.length(F.regexp_replace(low, "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), ""))
    made = {
        "length": n,
        "distinct_share": F.size(F.array_distinct(F.split(value, ""))) / n,
        "transition_share": (runs - 1) / n,
        "bigrams": mean_bigram(value, vocabulary),
        "vocabulary": known_share(value, vocabulary),
        "in_url": (F.regexp_extract("word", CREDENTIALS, 1) == value).cast("double"),
        "digit_share": share("[0-9]"),
        "upper_share": share("[A-Z]"),
        "hex": low.rlike("^[0-9a-f-]+$").cast("double"),
        "alternating": F.regexp_count(low, F.lit("[aeiouy][bcdfghjklmnpqrstvwxz]")) / n,
        "covered": 1 - covered / n,
        "slashes": F.regexp_count(value, F.lit("/")).cast("double"),
        "dots": F.regexp_count(F.col("word"), F.lit("[.]")).cast("double"),
        "numeric": value.rlike("^[0-9_-]+$").cast("double"),
        "dashes": F.regexp_count(value, F.lit("[-_]")).cast("double"),
        "path_word": has(F.lower(F.coalesce("path", F.lit(""))), "test|example|fixture|mock|doc|sample"),
        "key_before": has(before, KEY_WORDS),
        "other_before": has(before, OTHER_WORDS),
        "key_near": has(around, KEY_WORDS),
        "assigned": F.concat_ws(" ", "before1", "word").rlike("[=:]").cast("double"),
        "quoted": F.col("word").rlike("^[\"'`]|=[\"'`]").cast("double"),
        "words_around": F.regexp_count(around, F.lit("[a-z]{2,}")).cast("double"),
        "prefix": value.rlike(f"{PREFIX}|^eyJ|BEGIN .*PRIVATE KEY").cast("double"),
    }
    return found.select("*", *[F.coalesce(made[k].cast("double"), F.lit(0.0)).alias(k) for k in FEATURES])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def labelled_findings(spark: SparkSession, rows: int = TRAINING_ROWS) -> DataFrame:
    """Findings with labels, made by rule from row numbers: value, path, word, before2, before1, after1, label.

    Even rows are secrets (hex, base64, prefixed keys), odd rows are what scanners take for secrets:
    commit and checksum hex, uuids, card numbers, names, paths, placeholders. No one feature gives the
    label: a third of the secrets have no word of credentials beside them, a half of the others have
    one, and paths of tests and documents are likelier for what is no secret, even a keyed hex.
    """
    r = spark.range(0, rows, 1, 4)

    def pick(salt: str, *of: str) -> Column:
        return F.get(F.array(*map(F.lit, of)), F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(of))).cast("int"))

    def hashed(salt: str, bits: int = 256) -> Column:
        return F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), bits)

    b64 = F.regexp_replace(F.base64(F.unhex(hashed("b"))), "[=]", "")
    words = pick("w1", *DICTIONARY[::3])
    kind = F.pmod(F.xxhash64(F.lit("kind"), "id"), F.lit(12))
    real = (
        F.when(kind < 5, F.substring(hashed("a"), 1, 40))
        .when(kind < 7, F.substring(b64, 1, 40))
        .when(kind == 7, F.concat(F.lit("AKIA"), F.upper(F.substring(hashed("c"), 1, 16))))
        .when(kind == 8, F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(b64, "[+/]", "0"), 1, 36)))
        .when(kind == 9, F.substring(hashed("d"), 1, 32))
        .when(kind == 10, F.concat(F.lit("sk_live_"), F.substring(F.regexp_replace(b64, "[+/]", "1"), 1, 24)))
        .otherwise(hashed("e"))
    )
    number = F.lpad(F.pmod(F.xxhash64(F.lit("n"), "id"), F.lit(10**16)).cast("string"), 16, "4")
    h = hashed("f")
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    false = (
        F.when(kind < 2, F.substring(hashed("g"), 1, 40))
        .when(kind == 2, hashed("h"))
        .when(kind == 3, F.substring(hashed("i"), 1, 32))
        .when(kind == 4, uuid)
        .when(kind < 7, number)
        .when(kind == 7, F.concat_ws("_", words, pick("w2", *DICTIONARY[1::3]), pick("w3", *DICTIONARY[2::3]), F.substring(number, 1, 3)))
        .when(kind == 8, F.concat(F.initcap(words), F.initcap(pick("w2", *DICTIONARY[1::3])), F.lit("Handler"), F.substring(number, 1, 2)))
        .when(kind == 9, F.concat_ws("/", F.lit("src"), words, pick("w2", *DICTIONARY[1::3]), F.concat(pick("w3", *DICTIONARY[2::3]), F.substring(number, 1, 2))))
        .when(kind == 10, F.concat(F.lit("EXAMPLE_KEY_"), F.substring(number, 1, 8), F.lit("_EXAMPLE")))
        .otherwise(F.concat(F.lit("xxxxxxxxxxxx"), F.substring(number, 1, 4), F.lit("xxxx")))
    )
    secret = F.col("id") % 2 == 0

    def dealt(salt: str, of: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(of))

    named = pick("k", "token", "api_key", "secret", "password", "auth_token", "access_key", "client_secret")
    other = pick("o", "commit", "sha256", "md5", "checksum", "version", "file", "uuid", "order", "sha1", "revision", "digest", "build")
    plain = pick("n", "the", "and", "reading", "of", "value", "with", "in", "then", "from", "send")
    # Every third row is of the other shapes: short values, values without a digit or with other marks, dotted ones, PEM.
    shape, odd_one = dealt("shape", 6), dealt("other", 3) == 0
    letters = F.translate(b64, "0123456789+/", "qRstUvWxYzkJ")
    shaped_real = (
        F.when(shape == 0, F.concat(words, F.substring(F.translate(h, "abcdef", "012345"), 1, 2), pick("mark", "x", "!", "q7", "@1", "$")))
        .when(shape == 1, F.concat(F.substring(letters, 1, 4), pick("mark", ".", "!", "@", "$", "="), F.substring(b64, 9, 5), pick("mark2", "!", "x", "7", "$")))
        .when(shape == 2, F.substring(letters, 3, 24))
        .when(shape == 3, F.substring(F.regexp_replace(b64, "[+/]", "5"), 5, 12))
        .when(shape == 4, F.concat(F.lit("eyJ"), F.substring(b64, 1, 17), F.lit("."), F.lit("eyJ"), F.substring(b64, 9, 21), F.lit("."), F.substring(b64, 3, 40)))
        .otherwise(F.concat(F.lit("-----BEGIN "), pick("pem", "RSA ", "", "EC ", "OPENSSH "), F.lit("PRIVATE KEY-----")))
    )
    shaped_false = (
        F.when(shape == 0, F.rpad(F.concat(words, pick("ending", "ing", "ation", "ment", "able", "required")), 8, "s"))
        .when(shape == 1, F.concat(words, pick("mark", ".", "-", "_"), pick("w2", *DICTIONARY[1::3]), pick("call", "", "()", ".txt", ".get")))
        .when(shape == 2, F.concat(pick("w2", *DICTIONARY[1::3]), F.initcap(words), F.initcap(pick("w3", *DICTIONARY[2::3]))))
        .when(shape == 3, F.concat(F.substring(number, 1, 4), pick("dash", "-", "", "/"), F.substring(number, 5, 6)))
        .when(shape == 4, F.concat_ws(".", words, pick("w2", *DICTIONARY[1::3]), F.concat(pick("w3", *DICTIONARY[2::3]), words, F.lit("_host"), F.substring(number, 1, 2))))
        .otherwise(F.concat(F.lit("-----BEGIN "), pick("pem", "CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY"), F.lit("-----")))
    )
    holder = pick("v", "value", "session", "conn", "client", "cfg", "remote")
    sign = pick("s", "=", ":", "=", "is")
    bare, keyed = dealt("bare", 3) == 0, dealt("keyed", 2) == 0
    hexlike = (kind < 5) | (kind >= 9) & (kind != 10)
    hashlike = kind < 5
    # A secret is keyed, or bare: then its prefix or its alphabet tells, or for hex that it is assigned in quotes.
    # What is no secret is beside credential words too: a named hash (token commit 8f3a..), or in a test's path.
    fixture = ~odd_one & ~secret & hashlike & keyed & (dealt("fix", 3) == 0)
    beside = (
        F.when(secret & bare & hexlike, F.array(holder, F.lit("=")))
        .when(secret & bare, F.array(pick("b2", "the", "and", "of", "that", "in"), plain))
        .when(secret & (dealt("joined", 4) == 0), F.array(plain, F.concat(named, F.lit(":"))))
        .when(secret | fixture, F.array(named, sign))
        .when(keyed & hashlike, F.array(named, other))
        .when(keyed, F.array(named, sign))
        .when(dealt("signed", 3) == 0, F.array(other, sign))
        .otherwise(F.array(plain, F.when(hashlike | (dealt("named", 2) == 0), other).otherwise(plain)))
    )
    value = F.when(secret, F.when(odd_one, shaped_real).otherwise(real)).otherwise(F.when(odd_one, shaped_false).otherwise(false))
    usual = F.when(secret, F.array(named, sign)).when(keyed, F.array(named, F.when(dealt("signs", 3) == 0, plain).otherwise(sign))).otherwise(F.array(plain, F.concat(named, F.lit(":"))))
    beside = F.when(odd_one & (shape == 5), F.array(plain, plain)).when(odd_one, usual).otherwise(beside)
    in_quotes = F.when(odd_one & (shape == 5), False).when(~odd_one & secret & bare & hexlike, True).when(odd_one, dealt("q", 10) < 4).otherwise(dealt("q", 10) < F.when(secret | fixture | keyed & ~hashlike, 6).otherwise(2))
    # Some stand in a URL's credentials, whatever they are; a placeholder does too.
    in_url = (dealt("url", 12) == 0) & ~(odd_one & (shape >= 4)) & ~value.rlike("[/@:]")
    address = F.concat(pick("scheme", "postgres", "https", "mysql", "amqp"), F.lit("://"), pick("user", "admin", "app", "root", "service"), F.lit(":"), value, F.lit("@"), words, F.lit(".local/main"))
    quoted = F.when(in_url, address).when(in_quotes, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value)
    tail = pick("t", "", "", ",", ".", ")", ";")
    places = ("src0", "src7", "config/prod.env", "app/settings.py", "deploy/main.yml")
    tests = ("tests/fixtures/a.txt", "docs/example.md", "samples/mock.json")
    tested = F.when(fixture, True).when(secret, (dealt("tp", 8) == 0) & (odd_one | ~hexlike)).otherwise(dealt("tp", 8) < 3)
    return r.select(
        "id",
        value.alias("value"),
        F.when(tested, pick("p", *tests)).otherwise(pick("p", *places)).alias("path"),
        F.concat(quoted, tail).alias("word"),
        F.get(beside, F.lit(0)).alias("before2"),
        F.get(beside, F.lit(1)).alias("before1"),
        pick("a1", "the", "and", "for", "with", "").alias("after1"),
        secret.cast("double").alias("label"),
    )


def train(findings: DataFrame) -> RandomForestClassificationModel:
    """A forest fitted on labelled findings, at most TRAINING_ROWS of them (the first by hash of value and words).

    findings has the columns of labelled_findings(); rows without a label are left out.
    """
    some = findings.where(F.col("label").isNotNull()).orderBy(F.xxhash64("value", "before2", "before1", "word"), "value").limit(TRAINING_ROWS)
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(some)).select("features", F.col("label").cast("double"))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(table)


def scan(docs: DataFrame, forest: RandomForestClassificationModel, keys: tuple[str, ...] = ("doc_id",), text: str = "text", path: str | None = "source", least: float = 0.5) -> DataFrame:
    """All candidates of all rows: keys, word_no, nth, value, score (0 to 1) and secret (score >= least).

    Repeated rows give their candidates again, null keys stay null, and an empty table gives none.
    A null path is an unknown one. Values are shown with their middle masked.
    """
    found = features(candidates(docs, keys, text, path))
    judged = forest.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    score = F.get(vector_to_array("probability"), F.lit(1))
    hidden = F.concat(F.substring("value", 1, 4), F.lit("..."), F.expr("right(value, 2)"))
    return judged.select(*keys, "word_no", "nth", hidden.alias("value"), F.round(score, 6).alias("score"), (score >= least).alias("secret"))
