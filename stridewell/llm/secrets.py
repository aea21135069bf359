"""Operator 2: secret scans that link the parts of a credential.

Three kinds of spans stand by themselves: assignments of long values to words
like "password", access key identifiers, and long hexadecimal runs.  Other parts
are weak: short identifiers, bare mixed strings that may be secrets, and
endpoints.  A weak part is reported only if complementary parts lie in its
scope, so many characters around it; the parts of a document are joined by
interval, on buckets of that width, as a semi-join that emits no pairs.

Only DataFrame functions run here, in time linear in the text.  A span's place
comes from the lengths of what stands between matches (split) and of the matches
themselves (extract), so the base needs no shuffle; the link step shuffles only
the parts of documents that have a weak one, and narrow rows without texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import written
from .spans import SPAN, bound, joined, later, running, spans
from .text import read_table

# The patterns of the base, in the order of kinds, with the least length of what counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Patterns of weak parts.
WEAK_ID = r"""\b(?:A[KS]IA[A-Z0-9]{8,13}\b|(?i:client_id|access_id|access_key_id|user_?name|login|account_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,})"""
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])(?=[0-9A-Z+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"""(?:https?|wss?|jdbc:[a-z]+|postgres|mysql|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]+"""

#: Code points on either side of a part in which others belong to the same credential.
SCOPE = 300
#: Code points of a text that are masked at once.
_BLOCK = 4096
#: Rows with spans whose keys (one long each) are broadcast at most, so that only their texts meet the spans in a shuffle.
LOOKUP = 1_000_000
_KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")


def parts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (128 bits of the text) and the spans of each kind, one row per row of ``df``."""
    out = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    low = F.lower("text")
    words = F.lit(False)
    for w in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        words = words | low.contains(w)
    text = F.col("text")
    marks = text.contains("=") | text.contains(":") | text.contains("KIA") | text.contains("SIA")
    least = lambda kind, m: F.length(m) >= LEAST[kind]
    looks = {
        "assign": (ASSIGN, words, lambda m: least("assign", F.regexp_extract(m, ASSIGN, 2))),
        "access": (ACCESS, text.contains("AKIA"), lambda m: least("access", m)),
        # runs shorter than the least length never count, and a longer one is never cut by them
        "hex": (f"[0-9a-f]{{{LEAST['hex']},}}", text.rlike(f"[0-9a-f]{{{LEAST['hex']}}}"), None),
        "weak_id": (WEAK_ID, marks & text.rlike(WEAK_ID), None),
        "weak_secret": (WEAK_SECRET, text.rlike("[A-Za-z0-9+/_-]{20}") & text.rlike(WEAK_SECRET), None),
        "endpoint": (ENDPOINT, text.contains("://"), None),
    }
    out = out.withColumns({kind: spans(text, kind, _KINDS.index(kind), *look) for kind, look in looks.items()})
    return out.select("id", F.md5("text").alias("digest"), *_KINDS)


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak parts that have complementary ones in scope: id, digest, span.

    An identifier needs a secret, a secret an identifier or an endpoint, an endpoint both.
    A weak part inside a base span is that span again and doesn't count.
    """
    weak = [k for k in _KINDS if k not in LEAST]
    some = found.filter(sum((F.size(k) for k in weak), F.lit(0)) > 0)
    flat = some.select("id", "digest", F.explode(F.concat(*_KINDS)).alias("span")).select("id", "digest", "span.*").distinct()
    flat = flat.withColumn("role", F.when(F.col("kind").isin("access", "weak_id"), "id").when(F.col("kind") == "endpoint", "endpoint").otherwise("secret"))
    bucket = lambda c: F.floor(c / F.lit(scope))
    # every part lies in the buckets that it touches, and looks into those that its scope touches
    right = flat.select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("start").alias("r_start"), F.col("stop").alias("r_stop"), F.col("role").alias("r_role"), F.col("kind").alias("r_kind"), F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("stop")))).alias("r_bucket"))
    left = flat.filter(F.col("kind").isin(weak)).withColumn("bucket", F.explode(F.sequence(bucket(F.greatest(F.col("start") - scope, F.lit(0))), bucket(F.col("stop") + scope))))
    same = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")) & (F.col("bucket") == F.col("r_bucket"))
    near = (F.col("r_start") <= F.col("stop") + scope) & (F.col("r_stop") >= F.col("start") - scope)
    apart = (F.col("r_stop") <= F.col("start")) | (F.col("r_start") >= F.col("stop"))

    def having(role: str, other: str) -> DataFrame:
        own = left.filter(F.col("role") == role)
        return own.join(right.filter(F.col("r_role") == other), same & near & apart, "left_semi").drop("bucket").distinct()

    ends = having("endpoint", "id").intersect(having("endpoint", "secret"))
    kept = having("id", "secret").unionByName(having("secret", "id")).unionByName(having("secret", "endpoint")).unionByName(ends).distinct()
    base = right.filter(F.col("r_kind").isin(list(LEAST)))
    inside = F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")) & (F.col("r_start") < F.col("stop")) & (F.col("r_stop") > F.col("start"))
    at = kept.withColumn("bucket", F.explode(F.sequence(bucket(F.col("start")), bucket(F.col("stop")))))
    covered = at.join(base, inside & (F.col("bucket") == F.col("r_bucket")), "left_semi").drop("bucket").distinct()
    return kept.exceptAll(covered).select("id", "digest", F.struct("start", "rank", "kind", "stop").alias("span"))


def _all_spans(df: DataFrame, id_col: str, text_col: str, scope: int) -> DataFrame:
    """The rows of parts() with the linked weak spans as ``extra``."""
    found = written(parts(df, id_col, text_col), "secret-parts")
    weak = linked(found, scope).groupBy("id", "digest").agg(F.collect_list("span").alias("weak"))
    weak = weak.select(F.col("id").alias("w_id"), F.col("digest").alias("w_digest"), "weak")
    out = found.join(weak, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("digest") == F.col("w_digest")), "left")
    return out.withColumn("extra", F.coalesce(F.col("weak"), F.array().cast(SPAN)))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """id, n_assign, n_access, n_hex, base_sha256, spans and n_linked, one row per row of ``df``.

    Null and empty texts have no spans; repeated rows give repeated rows; a null id stays null.
    """
    out = _all_spans(df, id_col, text_col, scope)
    base = F.concat("assign", "access", "hex")
    return out.select("id", *[F.size(k).cast("long").alias(f"n_{k}") for k in LEAST], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, "extra")).alias("spans"), F.size("extra").cast("long").alias("n_linked"))


def _apart(found: Column) -> Column:
    """Sorted spans as stretches (start, stop) that don't overlap; those that only touch stay apart."""

    def of(s: Column) -> Column:
        def with_tops(tops: Column) -> Column:
            heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: s[i]["start"] >= tops[i])
            stop = lambda h, j: F.when(j + 1 < F.size(h), tops[F.get(h, j + 1)]).otherwise(F.array_max(F.transform(s, lambda x: x["stop"])))
            return bound(heads, lambda h: F.transform(h, lambda i, j: F.struct(s[i]["start"].alias("start"), stop(h, j).alias("stop"))))

        return bound(running(F.transform(s, lambda x: x["stop"]), later), with_tops)

    return bound(found, of)


def _masked(text: Column, found: Column, mark: str) -> Column:
    """The text with a mark for each stretch of spans, put together from blocks, so that no piece is looked for from the start."""
    size = F.lit(_BLOCK).cast("bigint")
    cut = lambda s: F.transform(F.sequence(F.floor(s["start"] / size), F.floor((s["stop"] - 1) / size)), lambda k: F.struct(k.cast("int").alias("k"), F.greatest(s["start"] - k * size, F.lit(0)).cast("int").alias("a"), F.least(s["stop"] - k * size, size).cast("int").alias("b"), (F.floor(s["start"] / size) == k).alias("first")))

    def of(blocks: Column) -> Column:
        def with_pieces(p: Column) -> Column:
            def with_heads(h: Column) -> Column:
                k = lambda i: p[h[i]]["k"]
                past = lambda i: F.when(i > 0, F.get(p, F.get(h, i - 1))["k"]).otherwise(-1)

                def block(f: Column, i: Column) -> Column:
                    own = F.slice(p, f + 1, F.when(i + 1 < F.size(h), F.get(h, i + 1)).otherwise(F.size(p)) - f)

                    def masked(text_: Column) -> Column:
                        def line(g: Column) -> Column:
                            before = lambda j: F.when(j > 0, F.get(g, j - 1)["b"]).otherwise(0)
                            each = F.transform(g, lambda x, j: F.concat(F.substring(text_, before(j) + 1, x["a"] - before(j)), F.when(x["first"], mark).otherwise("")))
                            return F.concat(F.array_join(each, ""), F.substring(text_, F.element_at(g, -1)["b"] + 1, F.lit(_BLOCK)))

                        return bound(own, line)

                    return F.concat(F.array_join(F.slice(blocks, past(i) + 2, k(i) - past(i) - 1), ""), bound(blocks[k(i)], masked))

                rest = F.slice(blocks, F.element_at(p, -1)["k"] + 2, F.size(blocks))
                return F.concat(F.array_join(F.transform(h, block), ""), F.array_join(rest, ""))

            return bound(F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (F.get(p, i - 1)["k"] != p[i]["k"])), with_heads)

        return bound(F.flatten(F.transform(_apart(found), cut)), with_pieces)

    return bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)), of)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``df`` with every span of its texts replaced by ``mark`` (overlapping ones by one mark); other columns stay.

    A row without spans is unchanged, a null text stays null, repeated rows and rows of a null id are masked each,
    in time linear in the text; names of other columns may be any but ``__id``, ``__digest`` and ``__spans``.
    Texts without spans stay where they are; those with spans meet these in a shuffle (beyond LOOKUP of them, all texts do).
    """
    found = _all_spans(df, id_col, text_col, scope).select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.array_sort(F.concat("assign", "access", "hex", "extra")).alias("__spans"))
    found = written(found.filter(F.size("__spans") > 0).dropDuplicates(["__id", "__digest"]), "secret-spans")
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (digest == F.col("__digest"))
    text = _masked(F.col(text_col), F.col("__spans"), mark)
    masked = lambda rows: rows.join(found, same, "left").select(*[F.when(F.col("__spans").isNull(), F.col(c)).otherwise(text).alias(c) if c == text_col else F.col(c) for c in df.columns])
    if found.count() > LOOKUP:
        return masked(df)
    # one long for each: a row that has it by chance finds no spans and stays as it is
    keys, own = F.broadcast(found.select(F.xxhash64("__id", "__digest").alias("__key")).distinct()), F.xxhash64(id_col, digest) == F.col("__key")
    return df.join(keys, own, "left_anti").unionByName(masked(df.join(keys, own, "left_semi")))


def op2_linked_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
