"""Hashes, manifests, encoded payloads, URLs and secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import js_compat as js


def content_hash(df: DataFrame, key: str, col: str) -> DataFrame:
    """key and sha256 (lower-case hex) of the bytes; null for null."""
    return df.select(key, F.sha2(F.col(col).cast("binary"), 256).alias("sha256"))


def duplicate_groups(hashed: DataFrame, key: str) -> DataFrame:
    """A row for each member of a group of equal hashes: key, sha256, n and keep_id, the group's smallest key."""
    groups = hashed.groupBy("sha256").agg(F.count("*").alias("n"), F.min(key).alias("keep_id")).where("n > 1")
    return hashed.join(groups, "sha256").select(key, "sha256", "n", "keep_id")


def verify_manifest(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key and status: match, mismatch, no_expected, unlisted (no entry) or missing (no file)."""
    wanted = expected.select(key, F.lower(F.regexp_replace("expected", js.SPACE, "")).alias("wanted"), F.lit(True).alias("listed"))
    both = actual.select(key, "sha256", F.lit(True).alias("there")).join(wanted, key, "full_outer")
    status = (
        F.when(F.col("there").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.coalesce("wanted", F.lit("")) == "", "no_expected")
        .when(F.col("wanted") == F.col("sha256"), "match").otherwise("mismatch")
    )
    return both.select(key, status.alias("status"))


def decode_payloads(df: DataFrame, key: str, col: str) -> DataFrame:
    """key, ok, reason (not_base64, not_utf8 or null) and decoded text."""
    raw = df.select(key, F.try_to_binary(F.regexp_replace(col, js.SPACE, ""), F.lit("base64")).alias("raw"))
    valid = F.is_valid_utf8(F.col("raw").cast("string"))
    reason = F.when(F.col("raw").isNull(), "not_base64").when(~valid, "not_utf8")
    return raw.select(key, reason.isNull().alias("ok"), reason.alias("reason"), F.when(reason.isNull(), F.col("raw").cast("string")).alias("decoded"))


def encode_payloads(df: DataFrame, key: str, col: str) -> DataFrame:
    return df.select(key, js.base64(F.col(col)).alias("payload"))


def url_components(df: DataFrame, key: str, col: str) -> DataFrame:
    """key, host, path, param, raw, value and ok of every query parameter; null param for a URL without a query."""
    # by pattern: a URL parser gives up on the whole URL where one escape is malformed
    part = lambda pattern: F.regexp_extract(F.coalesce(F.col(col), F.lit("")), pattern, 1)
    pairs = F.filter(F.split(part(r"^[^?#]*[?]([^#]*)"), "&"), lambda p: p != "")
    host, path = part(r"://(?:[^/?#@]*@)?([^/?#:]*)"), part(r"://[^/?#]*([^?#]*)")
    rows = df.select(key, host.alias("host"), path.alias("path"), F.explode_outer(pairs).alias("pair"))
    raw = F.when(F.instr("pair", "=") > 0, F.expr("substring(pair, instr(pair, '=') + 1)")).when(F.col("pair").isNotNull(), "")
    return rows.select(key, "host", "path", F.substring_index("pair", "=", 1).alias("param"), raw.alias("raw")).withColumn("value", js.url_decode(F.col("raw"))).withColumn("ok", F.col("raw").isNull() | F.col("value").isNotNull())


def url_encode_col(df: DataFrame, key: str, col: str) -> DataFrame:
    return df.select(key, js.url_encode(F.col(col)).alias("encoded"))


# fixed values: what each score is called
STRENGTHS = ("Not generated", "Fair", "Good", "Strong", "Very strong")


def _bits(token: Column) -> Column:
    """Bits of a secret by the pool of characters it draws from. What is only small letters, as most words are, and ASCII are seen
    to first, as the classes of white space beyond it are slow to look for."""

    def pool(space: str) -> Column:
        found = sum((F.when(token.rlike(p), n).otherwise(0) for p, n in (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), (f"[^A-Za-z0-9{space}]", 28))), F.lit(0))
        return F.when(token.rlike(f"[_{space}-]"), F.greatest(found, F.lit(48))).otherwise(found)

    ascii_only = F.octet_length(token) == F.length(token)
    pools = F.when(token.rlike(r"\A[a-z]++\z"), 26).when(ascii_only, pool(r"\s")).otherwise(pool(js.SPACE[1:-1]))
    length = js.utf16_length(token)
    return F.when(length == 0, 0).otherwise(F.round(length * F.log2(F.greatest(pools, F.lit(1)))).cast("int"))


def _ranked(token: Column, bits: Column) -> tuple[Column, Column]:
    """(score, label) of a secret and its bits."""
    score = F.when(bits >= 80, 4).when(bits >= 60, 3).when(bits >= 40, 2).when(token != "", 1).otherwise(0)
    return score, F.element_at(F.array(*map(F.lit, STRENGTHS)), score + 1)


def strength(token: Column) -> tuple[Column, Column, Column]:
    """(bits, score, label) of a secret by the pool of characters it draws from."""
    bits = _bits(token)
    return bits, *_ranked(token, bits)


def secret_strength(df: DataFrame, key: str, col: str, token_rule: str = "[0-9a-f]{32,64}") -> DataFrame:
    """key, the token's hash (never the token), bits, score and label of every token in the texts."""
    tokens = df.select(key, F.explode(F.regexp_extract_all(F.col(col), F.lit(f"({token_rule})"))).alias("token"))
    token, bits = F.col("token"), F.col("bits")
    # a generator, so that bits are worked out once for each token and not wherever they are looked at
    known = tokens.select(key, "token", F.explode(F.array(_bits(token))).alias("bits"))
    score, label = _ranked(token, bits)
    return known.select(key, F.sha2("token", 256).alias("token_sha256"), "bits", score.alias("score"), label.alias("label"))
