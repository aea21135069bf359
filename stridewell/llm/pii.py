r"""Operator 13: personal data by weak supervision.

Four kinds of spans stand by themselves: addresses of mail, IP addresses, card numbers and
telephone numbers.  Other candidates (names, postal addresses, identity numbers, accounts, dates of
birth, telephone numbers without a country, written-out mail addresses) are found broadly, and seven
labelers vote on each: its shape, gazetteers, words before it, words after it, words that speak against
it, other personal data in the document, and how a sentence begins.  Votes are counted by pattern, of
which there are at most 3 ** 7 for each kind, so expectation-maximisation over the counts needs one small
row for each kind: it estimates how reliable each labeler is and how likely each pattern of votes is
personal data.  A naive Bayes classifier of spans then learns from these likelihoods what such spans look
like, and decides.

Only DataFrame functions run here, in time linear in the text.  A text is read once; candidates stay in the
row of their document, and only counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import forget, written
from .spans import SPAN, bound, joined, matches, no_spans, spans
from .text import read_table

# The patterns of the base, in the order of kinds.  They match what these match:
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)            parts at most 255
#   card   [0-9]([\x20-]?[0-9])+                           12 to 19 digits, Luhn
#   phone  \+[0-9][\x20().0-9-]+[0-9]                      9 to 15 digits
# Repeats are possessive (nothing that follows could take back a character), a run is tried from its start or the
# end of the match before alone, and a card from 12 digits on, so that no run is read from each of its characters.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = ("email", "ip", "card", "phone")

#: Kinds that the method adds, in the order of their ranks after those of the base, and how a candidate of each looks.
ADDED = {
    "written_email": r"[A-Za-z0-9._%+-]{1,64}\x20?[\[({]\x20?at\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:[\[({]\x20?dot\x20?[\])}]|\.)\x20?[A-Za-z0-9-]{1,63}){1,4}",
    "account": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?",
    "identity": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "birth_date": r"(?:[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})",
    "local_phone": r"\(?[0-9]{2,5}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}",
    "address": r"(?:[0-9]{1,5}\x20(?:\p{Lu}\p{Ll}{1,20}\x20){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Court|Ct|Square|Way)|\p{Lu}\p{Ll}{2,20}(?:straße|strasse|weg|platz|gasse)\x20[0-9]{1,4}|[0-9]{1,4},?\x20(?:rue|avenue|boulevard|place)\x20(?:\p{L}{1,20}\x20){0,3}\p{Lu}\p{L}{1,20}|(?:Calle|Avenida|Plaza)\x20(?:\p{L}{1,20}\x20){0,3}\p{Lu}\p{L}{1,20},?\x20[0-9]{1,4})",
    "name": r"(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20)?\p{Lu}\p{Ll}{1,20}(?:\x20\p{Lu}\.)?(?:\x20\p{Lu}\p{Ll}{1,20}){1,2}",
}
KINDS = (*BASE, *ADDED)

# Gazetteers and words of context.
GIVEN = "Adam Alan Alice Amy Ana Andrea Andrew Anna Anne Antonio Barbara Ben Bernd Bob Brian Carlos Carmen Carol Caroline Charles Chloe Christian Christine Claire Claudia Daniel David Diego Dieter Elena Elizabeth Emily Emma Eric Eva Fernando Francisco Frank Gabriel George Grace Hans Heinz Helen Henry Hugo Ines Isabel Jack Jacques James Jane Javier Jean Jennifer Jessica John Jorge Jose Joseph Juan Julia Julien Karen Karl Katharina Kevin Klaus Laura Linda Lisa Louis Lucas Lucia Luis Manuel Marco Maria Marie Mark Markus Martin Mary Matthew Michael Michel Miguel Monika Nicolas Nina Olivia Pablo Patricia Paul Pedro Peter Petra Philippe Pierre Rachel Richard Robert Rosa Sabine Sandra Sarah Sophie Stefan Stephen Steven Susan Thomas Ursula Walter William Wolfgang".split()
NOT_NAMES = "The This That These Those There Then They When Where What Which Who Why How And But For Not You Your His Her Our Its All Any Some Each Every New North South East West United National University Street January February March April May June July August September October November December Monday Tuesday Wednesday Thursday Friday Saturday Sunday Der Die Das Und Ein Eine Les Des Une Los Las Una Del Para".split()
BEFORE = {
    "written_email": "mail|e-mail|contact|reach|write|kontakt|correo|courriel",
    "account": "iban|account|konto|compte|cuenta|bank",
    "identity": "ssn|social security|identity|passport|license|ausweis|dni",
    "birth_date": "born|birth|dob|geboren|geburt|naissance|née? le|nacid|nacimiento",
    "local_phone": "phone|tel|call|mobile|cell|fax|telefon|handy|téléphone|teléfono|móvil|portable",
    "address": "address|live|resid|home|ship|deliver|wohn|adresse|habite|dirección|vive|domicil",
    "name": "name|mr|mrs|ms|dr|dear|signed|regards|contact|patient|customer|herr|frau|monsieur|madame|señor|señora",
}
AFTER = r"^[\x20,;:(]{0,3}(?:born|age[d:]|lives|phone|tel|mail|e-mail|address|ssn|said|called|wrote|geboren|wohn|né|habite|vive|nacid)"
AGAINST = r"(?:version|isbn|issn|doi|order|invoice|figure|fig\.|table|section|chapter|page|ref|part|model|serial|port|copyright|license|released|published|updated|edition)(?:[\x20:#.-]|numbers?|nos?|nr){0,4}$"

#: The first four see the span or its words of context: without one of them for it, a span isn't added.
LABELERS = ("shape", "gazetteer", "before", "after", "against", "company", "sentence")
DIRECT = 4
#: Code points of context that labelers read, within what stands between a candidate and its neighbours.
CONTEXT = 60
#: Rounds of expectation-maximisation, and how likely a span must be to count.
ROUNDS = 12
LIKELY = 0.8
_CANDIDATE = "array<struct<start:bigint,stop:bigint,kind:int,votes:array<int>,looks:array<int>>>"
_EDGE = r"(?<![\p{L}\p{N}@._+-])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """12 to 19 digits whose sum is right, every second from the right counted double."""

    def total(d: Column) -> Column:
        at = lambda i: F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        one = lambda i: F.when(i % 2 == 1, F.when(at(i) >= 5, at(i) * 2 - 9).otherwise(at(i) * 2)).otherwise(at(i))
        right = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + one(i)) % 10 == 0
        return F.when(F.length(d).between(12, 19), right).otherwise(F.lit(False))

    return bound(_digits(m), total)


def _parts_fit(m: Column) -> Column:
    return F.forall(F.split(m, "[.]"), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(256)) <= 255)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each kind of the base."""
    rank = BASE.index
    return {
        "email": spans(text, "email", rank("email"), EMAIL, text.contains("@")),
        "ip": spans(text, "ip", rank("ip"), IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), _parts_fit),
        "card": spans(text, "card", rank("card"), CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), _luhn),
        "phone": spans(text, "phone", rank("phone"), PHONE, text.rlike(r"\+[0-9]"), lambda m: F.length(_digits(m)).between(9, 15)),
    }


def _kind_of(m: Column) -> Column:
    """The place in ADDED of the first kind that the whole match is of; -1 for what is left to the base."""
    out = F.lit(-1)
    for i, pattern in reversed(list(enumerate(ADDED.values()))):
        out = F.when(m.rlike(f"^(?:{pattern})$"), i).otherwise(out)
    return F.when(m.rlike(r"@|^\+|^[0-9]++(?:\.[0-9]++){3}$"), -1).when(F.length(_digits(m)) >= 12, F.when(m.rlike("^[A-Z]{2}"), out).otherwise(-1)).otherwise(out)


def _votes(kind: Column, m: Column, before: Column, after: Column, some: Column) -> Column:
    """1, 0 or -1 of each labeler."""
    names = list(ADDED)
    is_a = lambda name: kind == names.index(name)
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    low = F.lower(before)
    first = F.regexp_extract(m, r"(\p{Lu}\p{Ll}+)(?:\x20\p{Lu}\.)?\x20", 1)
    day = r"^(?:[0-2]?[0-9]|3[01])[./](?:0?[1-9]|1[0-2])[./]|^[0-9]{4}-(?:0[1-9]|1[0-2])-(?:[0-2][0-9]|3[01])$"
    n = F.length(_digits(m))
    shape = (
        F.when(is_a("written_email"), F.lit(1))
        .when(is_a("account"), vote(m.rlike(r"^[A-Z]{2}[0-9]{2}(?:\x20?[0-9]{4}){2}"), n < 10))
        .when(is_a("identity"), vote(~m.rlike("^(?:000|666|9)|-00-|0000$"), F.lit(True)))
        .when(is_a("birth_date"), vote(F.lit(False), ~m.rlike(day)))
        .when(is_a("local_phone"), vote(n.between(10, 11) & m.rlike(r"^\(?[0-9]{3,4}\)?"), ~n.between(9, 11)))
        .when(is_a("address"), F.lit(1))
        .otherwise(vote(m.rlike(r"^(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.?\x20"), F.lit(False)))
    )
    token = lambda words: "(?:^|\\x20)(?:" + "|".join(words) + ")(?:\\x20|$)"
    gazetteer = F.when(is_a("name"), vote(first.isin(GIVEN), m.rlike(token(NOT_NAMES)))).when(is_a("address"), vote(~m.rlike(token(NOT_NAMES[:12])), F.lit(False))).otherwise(0)
    cue = F.lit(False)
    for i, name in enumerate(names):
        # short words stand alone, longer ones may go on
        stems = "|".join(w + r"(?!\p{L})" if len(w) <= 4 else w for w in BEFORE[name].split("|"))
        cue = F.when(kind == i, low.rlike(rf"(?<!\p{{L}})(?:{stems})")).otherwise(cue)
    begins = is_a("name") & before.rlike(r"(?:^|[.!?:\n]|[.!?]\x20)$")
    return F.array(
        shape,
        gazetteer,
        vote(cue, F.lit(False)),
        vote(F.lower(after).rlike(AFTER), F.lit(False)),
        vote(F.lit(False), low.rlike(AGAINST)),
        vote(some, F.lit(False)),
        vote(F.lit(False), begins),
    ).cast("array<int>")


def _looks(m: Column, before: Column, after: Column) -> Column:
    """What the classifier sees of a span: small numbers, a bounded count of each."""
    side = lambda c: F.when(c == "", 0).when(c.rlike(r"[\x20\t]"), 1).when(c.rlike("[\n\r]"), 2).when(c.rlike(r"[,;:]"), 3).when(c.rlike(r"[.!?]"), 4).when(c.rlike(r"[(\[\"'<]"), 5).when(c.rlike(r"[\p{L}\p{N}]"), 6).otherwise(7)
    return F.array(
        F.least(F.floor(F.length(m) / 4), F.lit(15)),
        F.least(F.size(F.split(m, r"[\x20./-]")), F.lit(7)),
        F.least(F.length(_digits(m)), F.lit(15)),
        side(F.right(before, F.lit(1))),
        side(F.left(after, F.lit(1))),
        F.when(F.lower(before).rlike(r"(?::|=|\x20is|\x20at|\x20on|\x20to|\x20von|\x20de)\x20?$"), 1).otherwise(0),
        F.when(before == "", 0).when(F.length(before) < 20, 1).otherwise(2),
    ).cast("array<int>")


def candidates(text: Column, some: Column) -> Column:
    """Candidates of the added kinds with their votes; ``some``: the document has personal data of the base."""
    # what belongs to the base comes first, so that no candidate is cut out of it
    own = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+|\+[0-9](?:[\x20().-]*+[0-9])*+|[0-9]++(?:\.[0-9]++){3}"
    pattern = rf"{_EDGE}(?=[\p{{L}}\p{{N}}(+])(?:" + own.replace("]+@", "]{1,64}+@") + "|" + "|".join(ADDED.values()) + r")(?![\p{L}\p{N}@_])"
    near = lambda c, n: F.substring(c, n, CONTEXT)

    def make(start: Column, m: Column, before: Column, after: Column) -> Column:
        def of(x: Column) -> Column:
            return F.struct(start.cast("bigint").alias("start"), (start + F.length(m)).cast("bigint").alias("stop"), x["kind"].alias("kind"), F.when(x["kind"] >= 0, _votes(x["kind"], m, x["before"], x["after"], some)).alias("votes"), F.when(x["kind"] >= 0, _looks(m, x["before"], x["after"])).alias("looks"))

        return bound(F.struct(_kind_of(m).alias("kind"), F.when(F.length(before) > CONTEXT, near(before, -CONTEXT)).otherwise(before).alias("before"), near(after, 1).alias("after")), of)

    gate = text.rlike(r"[0-9]|\p{Lu}\p{Ll}++\x20(?:\p{Lu}\.\x20)?\p{Lu}\p{Ll}|[\[({]\x20?at\x20?[\])}]")
    return F.filter(matches(text, pattern, gate, make, _CANDIDATE), lambda c: c["kind"] >= 0)


def labelled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the spans of the base by kind, and ``found``, the candidates with their votes: one row per row of ``df``."""
    out = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = out.withColumns(base_spans(F.col("text")))
    some = sum((F.size(k) for k in BASE), F.lit(0)) > 0
    return out.withColumn("some", some).withColumn("found", candidates(F.col("text"), F.col("some"))).select("id", *BASE, "found")


def likelihoods(counts: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, votes and q: how likely a candidate with these votes is personal data.

    Expectation-maximisation over the patterns of votes of each kind, in one row with their counts (at most
    3 ** 7 patterns).  A labeler's votes are independent given the truth; pseudo-counts say
    that votes for are likelier where it is true, so the two classes can't change places, and that silence says nothing.
    """
    patterns = counts.groupBy("kind", "votes").agg(F.sum("n").cast("double").alias("n")).groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))
    one, votes = F.lit(1.0), F.array(*[F.lit(v) for v in (-1, 0, 1)])
    prior = {True: F.array(F.lit(0.5), F.lit(4.0), F.lit(2.0)), False: F.array(F.lit(2.0), F.lit(4.0), F.lit(0.5))}
    add = lambda a, x: a + x
    total = lambda xs: F.aggregate(xs, F.lit(0.0), add)
    # at first each vote counts the same
    start = F.transform("p", lambda p: one / (one + F.exp(F.lit(0.5) - F.aggregate(p["votes"], F.lit(0.0), lambda a, v: a + v.cast("double") * 1.5))))

    def ratios(q: Column) -> Column:
        """log of P(vote | true) / P(vote | false) for each labeler and vote."""
        weights = {True: F.zip_with("p", q, lambda p, x: F.struct(p["votes"].alias("votes"), (p["n"] * x).alias("w"))), False: F.zip_with("p", q, lambda p, x: F.struct(p["votes"].alias("votes"), (p["n"] * (one - x)).alias("w")))}

        def side(true: bool, w: Column, j: Column) -> Column:
            of = lambda v, pseudo: F.aggregate(w, pseudo, lambda a, p: a + F.when(p["votes"][j] == v, p["w"]).otherwise(0.0))
            each = F.transform(votes, lambda v, i: of(v, prior[true][i]))
            return bound(each, lambda e: bound(total(e), lambda t: F.transform(e, lambda x: F.log(x / t))))

        labelers = F.sequence(F.lit(0), F.lit(len(LABELERS) - 1))
        return bound(weights[True], lambda a: bound(weights[False], lambda b: F.transform(labelers, lambda j: F.zip_with(side(True, a, j), side(False, b, j), lambda x, y: x - y))))

    def round_(q: Column) -> Column:
        def with_prior(odds: Column) -> Column:
            def posterior(r: Column) -> Column:
                return F.transform("p", lambda p: bound(F.aggregate(F.sequence(F.lit(0), F.lit(len(LABELERS) - 1)), odds, lambda a, j: a + r[j][p["votes"][j] + 1]), lambda s: one / (one + F.exp(-s))))

            return bound(ratios(q), posterior)

        true = total(F.zip_with("p", q, lambda p, x: p["n"] * x))
        false = total(F.zip_with("p", q, lambda p, x: p["n"] * (one - x)))
        return bound(F.log((true + 1.0) / (false + 2.0)), with_prior)

    q = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda q, _: round_(q))
    each = patterns.withColumn("q", q).select("kind", F.explode(F.arrays_zip("p", "q")).alias("e"))
    return each.select("kind", F.col("e.p.votes").alias("votes"), F.col("e.q").alias("q"))


def span_model(counts: DataFrame, likely: DataFrame) -> DataFrame:
    """One row, ``model``: log odds by "kind/look/value" and, as "kind", of each kind.

    Naive Bayes over looks and votes, each candidate counted for as much as it is likely true, and false.
    ``likely`` has at most 7 * 3 ** 7 rows, so it is broadcast.
    """
    rows = counts.join(F.broadcast(likely), ["kind", "votes"])
    see = F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).alias("v"))), _seen(F.col("looks"), F.col("votes")))
    sums = rows.select("kind", (F.col("n") * F.col("q")).alias("t"), (F.col("n") * (1 - F.col("q"))).alias("f"), F.explode(see).alias("s")).groupBy("kind", "s.i", "s.v").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
    whole = sums.filter("i = -1").select("kind", F.col("t").alias("all_t"), F.col("f").alias("all_f"))
    odds = F.when(F.col("i") == -1, F.log((F.col("t") + 1) / (F.col("f") + 2))).otherwise(F.log((F.col("t") + 0.5) / (F.col("all_t") + 4)) - F.log((F.col("f") + 0.5) / (F.col("all_f") + 4)))
    key = F.when(F.col("i") == -1, F.col("kind").cast("string")).otherwise(F.concat_ws("/", "kind", "i", "v"))
    out = sums.join(F.broadcast(whole), "kind").agg(F.collect_list(F.struct(key.alias("k"), odds.alias("w"))).alias("m"))
    return out.select(F.map_from_entries("m").alias("model"))


def _seen(looks: Column, votes: Column) -> Column:
    n = 20  # more than there are looks
    pair = lambda base: lambda v, i: F.struct((i + base).alias("i"), v.alias("v"))
    return F.concat(F.transform(looks, pair(0)), F.transform(votes, pair(n)))


def _likely(c: Column, model: Column) -> Column:
    kind = c["kind"].cast("string")
    odds = F.aggregate(_seen(c["looks"], c["votes"]), F.coalesce(model[kind], F.lit(0.0)), lambda a, s: a + F.coalesce(model[F.concat_ws("/", kind, s["i"], s["v"])], F.lit(0.0)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", likely: float = LIKELY) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added, one row per row of ``df``.

    Null and empty texts have no spans, texts of any length are read whole, repeated rows give repeated rows,
    a null id stays null, an empty table gives no rows; other columns of ``df`` don't matter.
    """
    found = written(labelled(df, id_col, text_col), "pii-candidates")
    counts = written(found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.looks").agg(F.count("*").alias("n")), "pii-counts")
    model = written(span_model(counts, likelihoods(counts)), "pii-model")
    forget(counts)
    names = F.array(*[F.lit(k) for k in ADDED])
    seen = lambda c: F.exists(F.slice(c["votes"], 1, DIRECT), lambda v: v == 1)
    kept = F.filter("found", lambda c: seen(c) & (_likely(c, F.col("model")) >= likely))
    added = F.transform(kept, lambda c: F.struct(c["start"].alias("start"), (c["kind"] + len(BASE)).alias("rank"), names[c["kind"]].alias("kind"), c["stop"].alias("stop")))
    out = found.join(F.broadcast(model)).withColumn("added", F.when(F.size("found") > 0, added).otherwise(no_spans()).cast(SPAN))
    base = F.concat(*BASE)
    return out.select("id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.concat(base, "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op13_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
