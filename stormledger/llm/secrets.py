"""Secrets in texts: three fixed patterns, and windows of high entropy in the strings between.

Everything is a Column over one row: no shuffle, no Python, and a text of any length costs its
length. Positions are code points, end exclusive, and come from the pieces between matches.

Entropy: candidate strings (runs of CANDIDATE) that hold a letter and a digit and lie outside the
spans found by pattern are walked once. A window of WINDOW characters slides over them; the counts
of its characters and the sum of c * log2(c) over these counts are updated by the character that
enters and the one that leaves. Its entropy is log2(WINDOW) - sum / WINDOW. The limit depends on the
candidate's character class: hexadecimal strings have 16 symbols and reach less than others.
c * log2(c) is kept in whole millionths, so a sum updated a million times is exact.
Strings on the allow list (UUIDs, placeholders, alphabets, paths of plain words) are suppressed.

That is op7's contract, by which a string that touches a span or holds an allowed word is not walked
at all. With parts=True, which redact() uses, spans and allowed words are cut out of a candidate and
each part left is walked as a candidate of its own; other candidates give the same spans either way.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the three kinds, as the contract states them. The last two hold the
# least length: a shorter run fails as a whole, and nothing inside it could match.
KEYWORDS = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
ASSIGN = KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
LEAST_ASSIGNED = 6

WINDOW = 20
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Allowed as a whole string, by words anywhere in it, and as a whole string again.
ALLOWED_UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
ALLOWED_WORDS = (
    "[eE][xX][aA][mM][pP][lL][eE]", "[pP][lL][aA][cC][eE][hH][oO][lL][dD][eE][rR]", "[cC][hH][aA][nN][gG][eE][mM][eE]",
    "[aA][bB][cC][dD][eE][fF][gG][hH]", "01234567", "12345678",
)
ALLOWED_PATH = "^[+/_=-]*[A-Za-z]+[0-9]{0,4}([+/_=-]+[A-Za-z]*[0-9]{0,4})*$"
ALLOWED = "|".join([ALLOWED_UUID, *ALLOWED_WORDS, ALLOWED_PATH])
#: Least bits of a window that count as a secret, by the class of the candidate.
BITS = {"hex": 3.2, "other": 3.9}
SCALE = 1_000_000
XLOGX = [0 if c == 0 else round(SCALE * c * log2(c)) for c in range(WINDOW + 1)]
KINDS = ("assign", "access", "hex", "entropy")
SPAN = "array<struct<start:int,kind_no:int,end:int>>"


def most_sum(bits: float) -> int:
    """The largest sum of c * log2(c), in millionths, of a window with at least so many bits."""
    return int(SCALE * WINDOW * (log2(WINDOW) - bits))


def _located(text: Column, pattern: str) -> Column:
    """array<struct(start, hit)>: the leftmost non-overlapping matches, in order."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,hit:string>>").alias("found"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        return F.struct(
            (start + F.length(x["hit"])).alias("at"),
            F.array_append(state["found"], F.struct(start.alias("start"), x["hit"].alias("hit"))).alias("found"),
        )

    pairs = F.zip_with(gaps, hits, lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))
    walked = F.aggregate(F.filter(pairs, lambda x: x["hit"].isNotNull()), first, step)["found"]
    return F.when(F.size(hits) > 0, walked).otherwise(F.array().cast("array<struct<start:int,hit:string>>"))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), (x["start"] + F.length(x["hit"])).alias("end"),
    ))


def _hot_windows(hit: Column) -> Column:
    """struct(first, last): starts of the first and last window above the limit (-1: none)."""
    table = F.array(*[F.lit(v).cast("long") for v in XLOGX])
    limit = F.when(hit.rlike("^[0-9a-fA-F]+$"), F.lit(most_sum(BITS["hex"]))).otherwise(F.lit(most_sum(BITS["other"])))
    state = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"), F.lit(0).cast("long").alias("sum"),
        F.lit(-1).alias("first"), F.lit(-1).alias("last"),
    )

    def place(at: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substring(hit, at, F.lit(1))) - 1

    def step(s: Column, i: Column) -> Column:
        # One struct per stage of the step, so that no expression is stated twice.
        came = F.struct(s.alias("s"), place(i).alias("in"), F.when(i > WINDOW, place(i - WINDOW)).otherwise(F.lit(-1)).alias("out"))

        def moved(x: Column) -> Column:
            def at(k: Column) -> Column:
                return F.element_at(x["s"]["n"], (k + 1).cast("int"))

            def log_of(c: Column) -> Column:
                return F.element_at(table, (c + 1).cast("int"))

            change = F.when(x["in"] == x["out"], F.lit(0).cast("long")).otherwise(
                log_of(at(x["in"]) + 1) - log_of(at(x["in"]))
                + F.when(x["out"] >= 0, log_of(at(x["out"]) - 1) - log_of(at(x["out"]))).otherwise(F.lit(0).cast("long"))
            )
            counts = F.transform(x["s"]["n"], lambda c, k: c + (k == x["in"]).cast("int") - (k == x["out"]).cast("int"))
            return F.struct(
                counts.alias("n"), (x["s"]["sum"] + change).alias("sum"),
                x["s"]["first"].alias("first"), x["s"]["last"].alias("last"),
            )

        def judged(x: Column) -> Column:
            hot, start = (i >= WINDOW) & (x["sum"] <= limit), (i - WINDOW).cast("int")
            return F.struct(
                x["n"].alias("n"), x["sum"].alias("sum"),
                F.when(hot & (x["first"] < 0), start).otherwise(x["first"]).alias("first"),
                F.when(hot, start).otherwise(x["last"]).alias("last"),
            )

        return F.transform(F.transform(F.array(came), moved), judged)[0]

    return F.aggregate(
        F.sequence(F.lit(1), F.length(hit)), state, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"))
    )


def _parts(x: Column) -> Column:
    """array<struct(start, hit)>: candidates in what base spans and allowed words leave of a candidate."""
    end = x["start"] + F.length(x["hit"])
    none = F.array().cast("array<struct<start:int,end:int>>")
    touching = F.filter("base_spans", lambda b: (b["start"] < end) & (x["start"] < b["end"]))

    def step(s: Column, b: Column) -> Column:
        gap = F.array(F.struct(s["at"].alias("start"), b["start"].alias("end")))
        return F.struct(
            F.greatest(s["at"], b["end"]).alias("at"), F.when(b["start"] >= s["at"] + WINDOW, F.concat(s["gaps"], gap)).otherwise(s["gaps"]).alias("gaps"),
        )

    def cut(g: Column) -> Column:
        part = F.substring(x["hit"], g["start"] - x["start"] + 1, g["end"] - g["start"])
        blanked = part
        for word in ALLOWED_WORDS:
            blanked = F.regexp_replace(blanked, word, " " * (len(word) if word.isdigit() else word.count("[")))
        inner = F.transform(_located(blanked, CANDIDATE), lambda y: F.struct((g["start"] + y["start"]).alias("start"), y["hit"].alias("hit")))
        return F.when(~part.rlike(f"{ALLOWED_UUID}|{ALLOWED_PATH}"), inner).otherwise(F.array().cast("array<struct<start:int,hit:string>>"))

    first = F.struct(x["start"].alias("at"), none.alias("gaps"))
    gaps = F.aggregate(touching, first, step, lambda s: F.concat(s["gaps"], F.array(F.struct(s["at"].alias("start"), end.alias("end")))))
    return F.flatten(F.transform(F.filter(gaps, lambda g: g["end"] >= g["start"] + WINDOW), cut))


def find_secrets(df: DataFrame, text: str = "text", parts: bool = False) -> DataFrame:
    """df with `base_spans` and `secret_spans`, arrays of struct(start, kind_no, end) by (start, kind).

    base_spans holds the three fixed kinds, which may overlap each other; secret_spans adds the
    entropy spans, from the first to the last hot window of a candidate, none touching a base span.
    parts: what base spans and allowed words leave of a candidate is walked too.
    A null or empty text has no spans. Rows stand for themselves: repeated rows, ties and other
    columns change nothing. Columns of the two names are replaced.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    assigned = F.filter(
        _located(body, ASSIGN), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= LEAST_ASSIGNED
    )
    none = F.array().cast("array<struct<start:int,hit:string>>")
    access = F.when(F.contains(body, F.lit("AKIA")), _located(body, ACCESS)).otherwise(none)
    base = F.array_sort(F.concat(_spans(assigned, "assign"), _spans(access, "access"), _spans(_located(body, HEX), "hex")))
    out = df.withColumn("base_spans", base.cast(SPAN))

    def candidate(x: Column) -> Column:
        clear = ~F.exists("base_spans", lambda b: (b["start"] < x["start"] + F.length(x["hit"])) & (x["start"] < b["end"]))
        return clear & x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Za-z]") & ~x["hit"].rlike(ALLOWED)

    def mixed(x: Column) -> Column:
        return x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Za-z]")

    found = _located(body, CANDIDATE)
    if parts:
        # Kept from the tests after it, so that what was cut is not cut anew for each of them.
        cut = F.flatten(F.transform(F.filter(found, mixed), _parts))
        found = F.transform(F.array(cut), lambda c: F.filter(c, lambda x: mixed(x) & ~x["hit"].rlike(f"{ALLOWED_UUID}|{ALLOWED_PATH}")))[0]
    else:
        found = F.filter(found, candidate)
    walked = F.transform(
        found, lambda x: F.struct(x["start"].alias("start"), _hot_windows(x["hit"]).alias("w"))
    )
    hot = F.transform(
        F.filter(walked, lambda x: x["w"]["first"] >= 0),
        lambda x: F.struct(
            (x["start"] + x["w"]["first"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind_no"),
            (x["start"] + x["w"]["last"] + WINDOW).alias("end"),
        ),
    )
    return out.withColumn("secret_spans", F.array_sort(F.concat("base_spans", hot.cast(SPAN))))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"),
    )), ",")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """df with every secret in `text`, also in parts of strings, replaced by `mark`; overlapping spans become one mark.

    Texts without a secret, null and empty ones among them, stay as they are.
    """
    found = find_secrets(df, text, parts=True)
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        before = F.substring(F.col(text), s["at"] + 1, x["start"] - s["at"])
        return F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), F.concat(s["out"], before, F.lit(mark)).alias("out"))).otherwise(
            F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))
        )

    done = F.aggregate("secret_spans", state, step, lambda s: F.concat(
        s["out"], F.substring(F.col(text), s["at"] + 1, F.length(F.col(text)))
    ))
    return found.withColumn(text, F.when(F.size("secret_spans") > 0, done).otherwise(F.col(text))).drop("base_spans", "secret_spans")
