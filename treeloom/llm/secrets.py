"""Secret scans: candidate patterns, and a random forest that removes false positives, all as column expressions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh, kept

#: What a candidate looks like. Runs with a digit or an issuer's prefix; what stands after a name of a secret; private keys to their end, or
#: where that is missing, with the lines of the body that follow.
RUN = r"(?<![\w+/.~-])(?=[A-Za-z_+/.~-]*+[0-9]|AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|rk_live_|AIza|eyJ|glpat-)[\w+/.~-]{16,}={0,2}"
KEYED = r"(?i:pass(?:word|wd)?|pwd|secret|token|(?:api|access|auth|secret)[_-]?key|bearer)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"'<>,;]{6,})"
HEADER = (
    r"-----BEGIN [A-Z ]*?PRIVATE KEY(?: BLOCK)?-----(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]*?PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)*+)"
)
#: issuers' prefixes, names before a secret, names before what only looks like one, stand-ins, common words.
PREFIXES = r"^(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|rk_live_|AIza|eyJ|glpat-|-----BEGIN)"
NAMES = r"(?i)(?:pass(?:word|wd)?|pwd|secret|token|key|bearer|auth|credential)[\"']?\s{0,3}[=:]?\s{0,3}[\"']?$"
OTHERS = r"(?i)(?:commit|revision|sha-?\d*|md5|checksum|digest|hash|uuid|guid|version|build|isbn|iban|phone|tel|order|invoice|etag|ref|id|see|at|file|path|https?://|www\.|integrity)[\"']?\s{0,2}[=:#]?\s{0,2}[\"']?$"
STAND_INS = r"(?i)example|sample|changeme|placeholder|dummy|your[-_]|xxxx|\*\*\*\*|<|redacted|12345678|qwerty|letmein"
DICTIONARY = (
    "about after again all also and any app are article back base beta blog but can case code com company config content data date day default dev document "
    "doc docs down edu end example file first for from get has have here home html http https image images index info into item just key lib license like line list local "
    "log long mail main make many master meta more most name net new news next not now number off one only open org other our out over package page part path people "
    "php place post public python query read ref release report run sample see server service set site size some src start static system table test text than that the their "
    "them then there these they this time title tmp token two type under update upload use user usr value var version view was way web were what when which will with word work www year you your"
).split()
REPLACEMENT = "[SECRET]"
#: Transitions between classes of characters: lower, upper, digit, other.
TRANSITIONS = tuple(a + b for a in "ludo" for b in "ludo" if a != b)
FEATURES = (
    "length", "digits", "upper", "lower", "distinct", "changes", *(f"from_{a}_to_{b}" for a, b in TRANSITIONS), "usual_pairs", "words", "covered", "path", "segments", "hex", "prefix", "named", "other", "quoted", "dashes", "stand_in", "near_words", "near_known",
)
TREES, DEPTH = 15, 8
#: Characters of a text that are looked at before and after a candidate; the shortest match of a pattern; lengths that are summed at once.
BEFORE, AFTER, SHORTEST, CHUNK = 40, 24, 6, 256


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, b: a + b)


def _matches(body: Column, pattern: str, group: int) -> Column:
    """Every match of a pattern in its place: array of start (characters from 0), value, left, right. The group ends with the match."""
    whole = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))

    def read(w: Column) -> Column:
        value = F.regexp_extract_all(body, F.lit(pattern), F.lit(group)) if group else w
        return F.struct(w.alias("whole"), value.alias("value"), F.split(body, pattern, -1).alias("gaps"))

    def measured(r: Column) -> Column:
        # gap i stands before match i, and one more behind the last
        return F.struct(
            r["whole"].alias("whole"),
            r["value"].alias("value"),
            r["gaps"].alias("gaps"),
            F.zip_with(F.slice(r["gaps"], F.lit(1), F.size(r["whole"])), r["whole"], lambda g, m: (F.length(g) + F.length(m)).cast("long")).alias("sizes"),
            F.zip_with(r["gaps"], r["whole"], lambda g, m: F.right(F.concat(F.right(g, F.lit(BEFORE)), F.right(F.coalesce(m, F.lit("")), F.lit(BEFORE))), F.lit(BEFORE))).alias("tails"),
            F.zip_with(r["gaps"], r["whole"], lambda g, m: F.left(F.concat(F.left(g, F.lit(AFTER)), F.left(F.coalesce(m, F.lit("")), F.lit(AFTER))), F.lit(AFTER))).alias("heads"),
        )

    def placed(r: Column) -> Column:
        def add(sums: Column, k: Column) -> Column:
            return F.concat(sums, F.array(F.when(k == 0, F.lit(0).cast("long")).otherwise(F.element_at(sums, -1) + _sum(F.slice(r["sizes"], (k - 1) * CHUNK + 1, F.lit(CHUNK))))))

        def one(sums: Column, m: Column, i: Column) -> Column:
            chunk, back, ahead = F.floor(i / CHUNK).cast("int"), -(-BEFORE // SHORTEST), -(-AFTER // SHORTEST) + 1
            v = F.get(r["value"], i)
            end = F.get(sums, chunk) + _sum(F.slice(r["sizes"], chunk * CHUNK + 1, i % CHUNK + 1))
            passed = F.array_join(F.slice(r["tails"], F.greatest(i - back, F.lit(0)) + 1, F.least(i, F.lit(back))), "")
            named = F.left(m, F.length(m) - F.length(v))
            return F.struct(
                (end - F.length(v)).cast("int").alias("start"),
                v.alias("value"),
                F.right(F.concat(passed, F.right(F.get(r["gaps"], i), F.lit(BEFORE)), named), F.lit(BEFORE)).alias("left"),
                F.left(F.array_join(F.slice(r["heads"], i + 2, F.lit(ahead)), ""), F.lit(AFTER)).alias("right"),
            )

        sums = F.aggregate(F.sequence(F.lit(0), F.floor(F.size(r["whole"]) / CHUNK).cast("int")), F.array().cast("array<bigint>"), add)
        return _let(sums, lambda t: F.transform(r["whole"], lambda m, i: one(t, m, i)))

    none = F.array().cast("array<struct<start:int,value:string,left:string,right:string>>")
    return _let(whole, lambda w: F.when(F.size(w) == 0, none).otherwise(_let(read(w), lambda r: _let(measured(r), placed))))


def candidates(text: Column) -> Column:
    """Every place of a candidate in a text, in order: array of start, value and the text to its left and right. What two patterns find in one place counts once."""
    body = F.coalesce(text, F.lit(""))
    found = F.array_sort(F.concat(*[_matches(body, p, g) for p, g in ((RUN, 0), (KEYED, 1), (HEADER, 0))]))
    return _let(found, lambda all: F.filter(all, lambda c, i: (i == 0) | ~c.eqNullSafe(F.get(all, i - 1))))


def usual_pairs(words: list[str] = DICTIONARY, least: int = 3) -> list[str]:
    """Pairs of letters that follow each other in at least so many of the words."""
    times: dict[str, int] = {}
    for w in words:
        for pair in {w[i : i + 2] for i in range(len(w) - 1)}:
            times[pair] = times.get(pair, 0) + 1
    return sorted(p for p, n in times.items() if n >= least)


def describe(value: Column, left: Column, right: Column, known: list[str] = DICTIONARY) -> Column:
    """The forest's features of a candidate between the text on its left and right, as a struct of doubles.

    Length; shares of kinds of characters; transitions between kinds and usual pairs of letters, a character; coverage by short
    dictionary words anywhere and by known words between other characters; path marks; prefix; and the neighbouring words.
    """
    n = F.greatest(F.length(value), F.lit(1))

    def share(pattern: str) -> Column:
        return F.length(F.regexp_replace(value, pattern, "")) / n

    classes = F.translate(F.regexp_replace(value, "[^a-zA-Z0-9]", "-"), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-", "l" * 26 + "u" * 26 + "d" * 10 + "o")
    moves = {pair: (F.length(classes) - F.length(F.replace(classes, F.lit(pair), F.lit("")))) / 2 for pair in TRANSITIONS}
    changed = F.regexp_replace(value, r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])", "\u0001")
    long_words = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w)))
    pairs = "(?=(?:" + "|".join(usual_pairs()) + "))"
    parts = F.split(F.lower(F.regexp_replace(value, "(?<=[a-z])(?=[A-Z])", "-")), "[^a-z]+")
    in_known = F.filter(parts, lambda w: (F.length(w) > 2) & w.isin(known))
    near = F.regexp_extract_all(F.concat(left, F.lit(" "), right), F.lit(r"[^\W\d_]{2,}"), F.lit(0))
    got = {
        "length": n,
        "digits": share("[^0-9]"),
        "upper": share("[^A-Z]"),
        "lower": share("[^a-z]"),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / n,
        "changes": (F.length(changed) - F.length(value)) / n,
        **{f"from_{a}_to_{b}": moves[a + b] / n for a, b in TRANSITIONS},
        "usual_pairs": (F.length(F.regexp_replace(F.lower(value), pairs, "\u0001")) - F.length(value)) / n,
        "words": 1 - F.length(F.regexp_replace(F.lower(value), long_words, "")) / n,
        "covered": F.length(F.array_join(in_known, "")) / n,
        "path": F.length(F.regexp_replace(value, "[^/.]", "")),
        "segments": F.size(parts),
        "hex": F.when(F.regexp_like(value, F.lit("^[0-9a-f]+$")), 1).otherwise(0),
        "prefix": F.when(F.regexp_like(value, F.lit(PREFIXES)), 1).otherwise(0),
        "named": F.when(F.regexp_like(left, F.lit(NAMES)), 1).otherwise(0),
        "other": F.when(F.regexp_like(left, F.lit(OTHERS)), 1).otherwise(0),
        "quoted": F.when(F.regexp_like(left, F.lit("[\"']$")) & F.regexp_like(right, F.lit("^[\"']")), 1).otherwise(0),
        "dashes": F.length(F.regexp_replace(value, "[^_-]", "")),
        "stand_in": F.when(F.regexp_like(value, F.lit(STAND_INS)), 1).otherwise(0),
        "near_words": F.size(near),
        "near_known": F.size(F.filter(near, lambda w: F.lower(w).isin(known))),
    }
    return F.struct(*[got[k].cast("double").alias(k) for k in FEATURES])


#: Fixed values of the made findings: names of secrets; text between a name and a value with what follows it; what stands before harmless values.
MADE_NAMES = "password pwd passwd secret token api_key api-key access_key auth_token client_secret SECRET_KEY user_password bearer_token".split()
MADE_SIGNS = (("=", " "), (": ", " "), (" = ", "\n"), ("='", "'"), ('="', '"'), (": '", "',"), ('": "', '",'), (":", ";"))
MADE_OTHERS = ("commit ", "checksum: ", "sha256:", "sha-1 ", "md5 ", "revision ", "uuid: ", "digest=", "etag: ", "version ", "ref ", "id=", "https://", "hash: ", "data:image/png;base64,", 'integrity="', "index ", "git checkout ", "/", "phone ")
MADE_PREFIXES = ("AKIA", "ASIA", "ghp_", "ghs_", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "AIza", "glpat-", "eyJ")


def labelled_findings(spark: SparkSession, n: int = 9000) -> DataFrame:
    """A bounded set of n findings with labels: value, before, after, label. Made by rule, as no table has labelled findings.

    What stands around a value is drawn apart from the value: random values behind a secret's name, prefixed values anywhere and private
    keys are secrets; words, stand-ins and names behind a secret's name, digests, identifiers, paths, links, versions and numbers
    are not.
    """

    def pick(salt: str, k: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(k))

    def one_of(salt: str, values: list) -> Column:
        return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (pick(salt, len(values)) + 1).cast("int"))

    def part(col: Column, low: int, high: int, salt: str) -> Column:
        return F.substring(col, F.lit(1), (low + pick(salt, high - low + 1)).cast("int"))

    def join(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    hexa = F.concat(digest("a"), digest("b"))
    mixed = F.concat(*[F.translate(F.base64(F.unhex(digest(x))), "+/=", "pQ7") for x in "cde"])
    digits = F.translate(digest("f"), "abcdef", "273946")
    words = F.array(*map(F.lit, DICTIONARY))
    word = {k: F.element_at(words, (pick(f"word{k}", len(DICTIONARY)) + 1).cast("int")) for k in range(1, 15)}.get
    uuid = join(F.substring(hexa, 1, 8), "-", F.substring(hexa, 9, 4), "-4", F.substring(hexa, 13, 3), "-a", F.substring(hexa, 16, 3), "-", F.substring(hexa, 20, 12))
    prefix = one_of("prefix", list(MADE_PREFIXES))
    capital = F.upper(F.substring(mixed, 1, 16))
    prefixed = F.when(prefix.isin("AKIA", "ASIA"), F.concat(prefix, F.when(pick("digitless", 4) == 0, F.translate(capital, "0123456789", "QWERTYUIOP")).otherwise(capital))).otherwise(
        F.concat(prefix, part(mixed, 18, 40, "size"), F.when(pick("dots", 3) == 0, F.concat(F.lit("."), F.substring(mixed, 50, 20))).otherwise(""))
    )
    shorts = join(part(mixed, 6, 11, "size"), one_of("mark", ["", "!", "#", "_", "@"]), F.substring(digits, 1, 2))
    random = one_of("random", [part(mixed, 20, 64, "size"), part(mixed, 20, 64, "size"), part(hexa, 18, 64, "size"), shorts, shorts, join(word(1), F.substring(digits, 1, 2), "!", F.upper(word(2))), join(part(mixed, 40, 86, "size"), "=="), uuid])
    key = join("-----BEGIN ", one_of("key", ["", "RSA ", "EC "]), "PRIVATE KEY-----", one_of("body", [F.lit(""), F.concat(F.lit("\n"), mixed), F.concat(F.lit("\n"), F.repeat(F.concat(mixed, F.lit("\n")), 12), F.lit("-----END PRIVATE KEY-----"))]))
    wordy = one_of(
        "wordy",
        [
            word(1), join(word(1), word(2)), join(word(1), "_", word(2)), join(word(1), "-", word(2), "-", word(3)), join("changeme", F.substring(digits, 1, 3)), join("your-", word(1), "-here"), join("xxxxxxxxxxxxxxxx", F.substring(digits, 1, 2)),
            join("<", word(1), "-", word(2), ">"), join("example", F.substring(digits, 1, 4)), join(word(1), "_", word(2), "_", F.substring(digits, 1, 2)), join("${", F.upper(word(1)), "_", F.upper(word(2)), "}"), join(word(1), ".", word(2), "(", word(3), ")"), F.lit("********"),
        ],
    )
    harmless = one_of("harmless", [part(hexa, 32, 64, "size"), part(hexa, 32, 64, "size"), uuid, join(part(mixed, 24, 88, "size"), "=="), F.substring(digits, 1, 16), join(F.substring(digits, 1, 1), ".", F.substring(digits, 2, 2), ".", F.substring(digits, 4, 3), "-beta.", F.substring(digits, 7, 1))])
    named = one_of(
        "named",
        [
            join("/", word(1), "/", word(2), "/", word(3), F.substring(digits, 1, 2), "/", word(4), ".py"), join(word(1), ".com/", word(2), "/20", F.substring(digits, 1, 2), "/", word(3), "-", word(4), ".html"), join(word(1), "/", word(2), ".", F.substring(hexa, 1, 8), ".chunk.js"),
            join("20", F.substring(digits, 1, 2), "-05-1", F.substring(digits, 3, 1), "-10-22-", F.substring(digits, 4, 2), "-0000"), join(F.upper(word(1)), "_", F.upper(word(2)), "_", F.upper(word(3)), "_", F.substring(digits, 1, 1)), join(word(1), F.initcap(word(2)), F.initcap(word(3)), F.substring(digits, 1, 1), F.initcap(word(4))),
            join(word(1), "-", word(2), "-", word(3), "-", F.substring(digits, 1, 5)), join(word(1), ".", word(2), ".19", F.substring(digits, 1, 2)), join(word(1), "_", word(2), "_", F.substring(digits, 1, 1), "_", word(3)), join("DE", F.substring(digits, 1, 20)), join(word(1), word(2), word(3), word(4), F.substring(digits, 1, 1), word(5)),
            join("AKIA", F.upper(F.substring(mixed, 1, 9)), "EXAMPLE"), join("v", F.substring(digits, 1, 1), ".", F.substring(digits, 2, 2), "-", word(1), "-", word(2), ".tar.gz"), part(hexa, 40, 40, "size"), uuid,
        ],
    )
    said = lambda salt, ks: F.array_join(F.slice(F.array(*map(word, ks)), F.lit(1), pick(salt, len(ks) + 1).cast("int")), " ")
    plain, more = join(said("left", (6, 7, 8, 9, 10)), " "), said("right", (11, 12, 13, 14))
    sign = one_of("sign", [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in MADE_SIGNS])
    name = join(plain, one_of("name", list(MADE_NAMES)), sign["a"])
    other = join(plain, one_of("other", list(MADE_OTHERS)))
    after, ends = join(" ", more), join(sign["b"], more)
    kinds = [  # label, value, before, after
        (1, random, name, ends),
        (1, random, name, ends),
        (1, prefixed, plain, after),
        (1, prefixed, name, ends),
        (1, key, plain, F.lit("\n")),
        (0, wordy, name, ends),
        (0, wordy, name, after),
        (0, harmless, other, after),
        (0, named, plain, after),
        (0, named, other, after),
    ]
    made = F.array(*[F.struct(F.lit(y).alias("label"), v.alias("value"), a.alias("before"), z.alias("after")) for y, v, a, z in kinds])
    return spark.range(n).select(F.element_at(made, (F.col("id") % len(kinds) + 1).cast("int")).alias("f")).select("f.*")


def known_words(path: str, most: int = 800) -> list[str]:
    """The first words of at least four letters of a `tokenizers` vocabulary, whose order is that of frequency, and those of DICTIONARY."""
    with open(path, encoding="utf-8") as f:
        pieces = json.load(f)["model"]["vocab"]
    whole = [w[:-4] for w in sorted(pieces, key=pieces.get) if re.fullmatch(r"[a-z]{4,}</w>", w)]
    return sorted({*whole[:most], *DICTIONARY})


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, known: list[str] = DICTIONARY) -> list:
    """A random forest of labelled findings (value, before, after, label), as nested tuples (feature, threshold, at most, above) with leaves 0 or 1.

    The findings are a bounded sample by contract, and are gathered in one partition so that the same findings give the same forest.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = findings.select(F.col("label").cast("double").alias("label"), describe(F.col("value"), F.col("before"), F.col("after"), known).alias("f")).select("label", "f.*")
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(kept(rows.coalesce(1), "findings")).select("label", "features")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, maxBins=64).fit(rows)

    def node(x):
        if x.getClass().getSimpleName() == "LeafNode":
            return int(x.prediction())
        low, high = node(x.leftChild()), node(x.rightChild())
        return low if low == high and isinstance(low, int) else (x.split().featureIndex(), x.split().threshold(), low, high)

    return [node(t.rootNode()) for t in model._java_obj.trees()]


def vote(forest: list, features: Column) -> Column:
    """The share of trees that call it a secret."""

    def walk(node) -> Column:
        if isinstance(node, int):
            return F.lit(float(node))
        k, at, low, high = node
        return F.when(features[FEATURES[k]] <= at, walk(low)).otherwise(walk(high))

    total = walk(forest[0])
    for tree in forest[1:]:
        total = total + walk(tree)
    return total / len(forest)


def findings(text: Column, forest: list, threshold: float = 0.5, known: list[str] = DICTIONARY) -> Column:
    """All candidates of a text: array of value, start (characters from 0), score, is_secret. Null text: none.

    Every place is scored by what stands around it; a value is a secret in all its places if it is in one.
    """
    around = F.transform(candidates(text), lambda c: F.struct(c["value"].alias("value"), c["start"].alias("start"), describe(c["value"], c["left"], c["right"], known).alias("f")))
    scored = F.transform(around, lambda c: F.struct(c["value"].alias("value"), c["start"].alias("start"), vote(forest, c["f"]).alias("score")))

    def judged(all: Column) -> Column:
        real = F.array_distinct(F.transform(F.filter(all, lambda c: c["score"] >= threshold), lambda c: c["value"]))
        return _let(real, lambda r: F.transform(all, lambda c: F.struct(c["value"].alias("value"), c["start"].alias("start"), c["score"].alias("score"), F.array_contains(r, c["value"]).alias("is_secret"))))

    return _let(scored, judged)


def scan(docs: DataFrame, forest: list | None = None, key: str = "doc_id", text: str = "text", threshold: float = 0.5, known: list[str] = DICTIONARY) -> DataFrame:
    """A row for each place of a candidate in each row: key, value, start, score, is_secret.

    Only column expressions are used; every row is judged where it lies, without a shuffle. Texts without candidate, null and
    empty ones among them, give no row; repeated rows give theirs each, null keys too; texts of any length are scanned whole;
    an empty table gives no row; other columns are not read, so their names are free. A forest that is given must have been
    trained with the same known words.
    """
    forest = forest or train(labelled_findings(docs.sparkSession), known=known)
    one = docs.select(F.col(key).alias("key"), F.explode(findings(F.col(text), forest, threshold, known)).alias("one"))
    return one.select(F.col("key").alias(key), "one.*")


def redact(docs: DataFrame, forest: list | None = None, text: str = "text", threshold: float = 0.5, size: str | None = "n_chars", known: list[str] = DICTIONARY) -> DataFrame:
    """docs with every occurrence of every secret replaced by REPLACEMENT; all rows and columns stay as they are otherwise, whatever their names.

    The column named by `size`, if there is one, becomes the text's new length where the text has changed. Longer secrets are replaced first,
    of equal lengths the smaller. Null and empty texts stay; repeated rows change alike; texts of any length are masked
    whole; an empty table gives an empty one.
    """
    forest = forest or train(labelled_findings(docs.sparkSession), known=known)
    real = F.array_distinct(F.transform(F.filter(findings(F.col(text), forest, threshold, known), lambda c: c["is_secret"]), lambda c: c["value"]))
    real = F.transform(real, lambda v: F.struct((-F.length(v)).alias("n"), v.alias("value")))
    new = F.aggregate(F.array_sort(real), F.col(text), lambda acc, c: F.replace(acc, c["value"], F.lit(REPLACEMENT)))
    masked, kinds = fresh(docs, "masked")[0], dict(docs.dtypes)
    same = F.col(masked).isNull() | F.col(masked).eqNullSafe(F.col(text))
    out = {c: F.col(c) for c in docs.columns} | {text: F.col(masked).alias(text)}
    if size in out:
        out[size] = F.when(same, F.col(size)).otherwise(F.length(masked)).cast(kinds[size]).alias(size)
    return docs.withColumn(masked, new).select(*out.values())
