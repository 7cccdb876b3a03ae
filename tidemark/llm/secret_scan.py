"""Secret scan with multipart credential linking, in DataFrame functions only.

A pattern's matches are put between two marks, the text is split at the marks, and the running lengths of the parts are the
matches' places in code points. Besides the base kinds the scan finds weak parts: access identifiers, endpoints, and long mixed
tokens that alone prove nothing. A weak token is reported, as ``linked``, only when a part of another kind stands within its
scope: an interval join of the parts of a document, by buckets of the scope's width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import materialize

#: The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: The weak parts.
IDENTIFIER = r"""(?i:\b(?:user|username|login|account|client_id|access_key_id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,64}"""
ENDPOINT = r"""(?i:\b(?:https?|jdbc:[a-z]+|s3|ftp|postgres|mysql|mongodb|redis))://[^\x00-\x20"'<>]+|\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"""
LETTER = "[A-Za-z0-9+/_-]"
TOKEN = rf"(?<!{LETTER})(?={LETTER}{{20}})(?=[A-Za-z+/_-]*+[0-9])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z]){LETTER}++"
#: The words of the patterns, one of which each match holds.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
IDENTIFIER_WORDS = ("user", "login", "account", "client_id", "access_key_id")
#: Code points between a weak token and its complement.
SCOPE = 200
KINDS = ("assign", "access", "hex", "linked")
_OPEN, _CLOSE, _OTHER = "\u0001", "\u0002", "\u0003"


def scan(items: Column, zero: Column, step, emit, after) -> Column:
    """An array in order of ``items``: ``emit(state, x)`` with the state before x, made by ``step`` from ``zero`` on; ``after`` takes the outputs
    of each block of about the square root of n items. Arrays that grow by one item are copied each time, so none grows longer than that.
    ``items`` is evaluated once: as the variable of a lambda, as an expression named in a lambda is evaluated again for each item."""
    return F.transform(F.array(items), lambda bound: _scan(bound, zero, step, emit, after))[0]


def _scan(items: Column, zero: Column, step, emit, after) -> Column:
    size = F.greatest(F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int"), F.lit(1))
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(items) - 1, F.lit(0)), size), lambda i: i < F.size(items))
    block = lambda i: F.slice(items, i + 1, size)
    none = F.filter(F.array(zero), lambda x: F.lit(False))
    # The state before each block, then the blocks one by one.
    begun = F.aggregate(starts, F.struct(zero.alias("state"), none.alias("out")), lambda a, i: F.struct(F.aggregate(block(i), a["state"], step).alias("state"), F.concat(a["out"], F.array(a["state"])).alias("out")), lambda a: a["out"])

    def one(x: Column) -> Column:
        empty = F.filter(F.array(emit(zero, items[0])), lambda v: F.lit(False))
        begin = F.struct(x["before"].alias("state"), empty.alias("out"))
        return after(x["before"], F.aggregate(block(x["i"]), begin, lambda a, v: F.struct(step(a["state"], v).alias("state"), F.concat(a["out"], F.array(emit(a["state"], v))).alias("out"))))

    return F.transform(F.zip_with(starts, begun, lambda i, before: F.struct(i.alias("i"), before.alias("before"))), one)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: start, end (exclusive) and text of the leftmost non-overlapping matches, in code points."""
    clean = F.translate(text, _OPEN + _CLOSE, _OTHER + _OTHER)
    parts = F.split(F.regexp_replace(clean, pattern, f"{_OPEN}$0{_CLOSE}"), f"[{_OPEN}{_CLOSE}]")
    # Every second part is a match.
    zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit"))
    step = lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), (~a["hit"]).alias("hit"))
    emit = lambda a, x: F.struct(a["at"].alias("s"), (a["at"] + F.length(x)).alias("e"), x.alias("m"), a["hit"].alias("hit"))
    found = F.flatten(scan(parts, zero, step, emit, lambda before, a: F.filter(a["out"], lambda x: x["hit"])))
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m")))


def places(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), x["e"].alias("e")))


def _printed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with __base (sorted base spans) and __weak, __part (weak tokens and the parts that can confirm them).

    A pattern runs only on texts that hold what each of its matches holds: a long run of its letters, or one of its words. Matches that are
    too short are dropped after matching, so they still take their place."""
    text, low = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col("__low")
    none = F.array().cast("array<struct<s:int,kind:int,e:int>>")
    has = lambda words: _any([F.contains(low, F.lit(w)) for w in words])
    given = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    docs = docs.withColumn("__low", F.lower(text)).withColumns({"__run": F.rlike(text, F.lit(f"(?<!{LETTER}){LETTER}{{20}}")), "__word": given & has(ASSIGN_WORDS), "__user": given & has(IDENTIFIER_WORDS), "__host": F.contains(text, F.lit("://")) | F.rlike(text, F.lit(r"[0-9]\.[0-9]"))})
    assign = places(F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6), 0)
    access = places(F.filter(matches(text, ACCESS), lambda x: x["e"] - x["s"] >= 20), 1)
    # The maximal runs of hex digits with 24 or more of them: shorter runs need no place.
    long_hex = places(matches(text, rf"(?<![0-9a-f]){HEX[:-1]}{{24,}}"), 2)
    only = lambda guard, found: F.when(guard, found).otherwise(none)
    akia, user, host = F.col("__run") & F.contains(text, F.lit("AKIA")), F.col("__user"), F.col("__host")
    docs = docs.withColumns({
        "__base": F.array_sort(F.concat(only(F.col("__word"), assign), only(akia, access), only(F.col("__run"), long_hex))),
        "__part": F.when(F.col("__run"), F.concat(only(user, places(matches(text, IDENTIFIER), 0)), only(host, places(matches(text, ENDPOINT), 1)))).otherwise(none),
    })
    # Without a part that could confirm it, a weak token is nothing.
    wanted = (F.size("__part") > 0) | F.exists("__base", lambda x: x["kind"] == 1)
    return docs.withColumn("__weak", only(wanted, places(matches(text, TOKEN), 3))).drop("__run", "__word", "__user", "__host", "__low")


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def link(found: DataFrame, key: str) -> DataFrame:
    """key, __linked: weak tokens within SCOPE of an identifier, an endpoint or an access span that they do not overlap, and outside all base spans."""
    have = found.where("size(__weak) > 0").dropDuplicates([key])
    weak = have.select(key, F.explode("__weak").alias("w")).select(key, F.col("w.s").alias("s"), F.col("w.e").alias("e"))
    base = have.select(key, F.explode("__base").alias("b")).select(key, F.col("b.s").alias("bs"), F.col("b.e").alias("be"), F.col("b.kind").alias("kind"))
    part = have.select(key, F.explode("__part").alias("b")).select(key, F.col("b.s").alias("bs"), F.col("b.e").alias("be")).unionByName(base.where("kind = 1").drop("kind"))
    bucket = lambda c: F.floor(c / SCOPE)
    # Buckets that an interval touches; tokens also take the buckets one scope to either side.
    touched = lambda df, s, e, more: df.withColumn("bucket", F.explode(F.sequence(bucket(F.col(s)) - more, bucket(F.col(e)) + more)))
    near = (F.col("bs") < F.col("e") + SCOPE) & (F.col("s") < F.col("be") + SCOPE) & ~((F.col("bs") < F.col("e")) & (F.col("s") < F.col("be")))
    over = (F.col("bs") < F.col("e")) & (F.col("s") < F.col("be"))
    left, right = touched(weak, "s", "e", 1), touched(part, "bs", "be", 0).withColumnsRenamed({key: "__k", "bucket": "__b"})
    linked = left.join(right, (F.col(key) == F.col("__k")) & (F.col("bucket") == F.col("__b")) & near, "left_semi").select(key, "s", "e").distinct()
    taken = touched(base.drop("kind"), "bs", "be", 0).withColumnsRenamed({key: "__k", "bucket": "__b"})
    inside = touched(linked, "s", "e", 0).join(taken, (F.col(key) == F.col("__k")) & (F.col("bucket") == F.col("__b")) & over, "left_semi").select(key, "s", "e").distinct()
    free = linked.join(inside, [key, "s", "e"], "left_anti")
    return free.groupBy(key).agg(F.collect_list(F.struct("s", F.lit(3).alias("kind"), "e")).alias("__linked"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets of each document: id, n_assign, n_access, n_hex, base_sha256 and spans (``kind:start:end``, code points, end exclusive).

    One row per input row, repeated rows included. Null texts are empty. Null ids stay null. Other columns are ignored.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.struct(F.xxhash64("id", "text").alias("a"), F.xxhash64("text", "id").alias("b")))
    found = materialize(find_spans(src).drop("text"), "secrets")
    linked = link(found, "key")
    out = found.join(linked, "key", "left")
    none = F.array().cast("array<struct<s:int,kind:int,e:int>>")
    count = lambda k: F.size(F.filter("__base", lambda x: x["kind"] == k)).cast("long")
    return out.select(
        F.col("id").alias(id_col),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_printed(F.col("__base")), 256).alias("base_sha256"),
        _printed(F.concat("__base", F.coalesce("__linked", none))).alias("spans"),
    )


def _masked(text: Column, spans: Column, mask: str) -> Column:
    """The text with each span (sorted; they may overlap) replaced by the mask. A block of spans takes its places in its own stretch of the text."""
    zero = F.struct(F.lit(0).alias("to"), F.lit(0).alias("pad"))
    step = lambda a, x: F.struct(F.greatest(a["to"], x["e"]).alias("to"), F.lit(0).alias("pad"))
    emit = lambda a, x: F.struct(a["to"].alias("to"), x["s"].alias("s"))

    def stretch(before: Column, done: Column) -> Column:
        own = F.array(F.substring(text, before["to"] + 1, done["state"]["to"] - before["to"]))
        # One stretch, cut at its spans; a span that begins before the last one ends adds nothing.
        return F.array_join(F.flatten(F.transform(own, lambda t: F.transform(done["out"], lambda x: F.when(x["s"] >= x["to"], F.concat(F.substring(t, x["to"] - before["to"] + 1, x["s"] - x["to"]), F.lit(mask))).otherwise("")))), "")

    def whole(sorted_spans: Column) -> Column:
        end = F.array_max(F.transform(sorted_spans, lambda x: x["e"]))
        return F.concat(F.array_join(scan(sorted_spans, zero, step, emit, stretch), ""), F.substring(text, end + 1, F.length(text)))

    return F.transform(F.array(spans), whole)[0]


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with all found spans in the text, linked ones too, replaced by ``mask``. Null and empty texts stay; repeated rows are each
    masked; an empty table stays empty. All columns keep their names, also those that the scan itself uses.

    The spans are found once and written. Only texts with weak tokens take part in the interval join; all others are masked where they are.
    """
    # Own names for all columns, so that none clashes with those of the scan.
    own = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    names, text = own.columns, f"c{docs.columns.index(text_col)}"
    found = materialize(find_spans(own, text).withColumn("__key", F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))), "spans")
    linked = link(found.where("size(__weak) > 0").select("__key", "__base", "__weak", "__part"), "__key")
    none = F.array().cast("array<struct<s:int,kind:int,e:int>>")
    doubtful = found.where("size(__weak) > 0").join(linked, "__key", "left").withColumn("__spans", F.concat("__base", F.coalesce("__linked", none)))
    both = found.where("size(__weak) = 0").withColumn("__spans", F.col("__base")).select(*names, "__spans").unionByName(doubtful.select(*names, "__spans"))
    masked = F.when(F.size("__spans") > 0, _masked(F.col(text), F.array_sort("__spans"), mask)).otherwise(F.col(text))
    return both.withColumn(text, masked).select(*names).toDF(*docs.columns)
