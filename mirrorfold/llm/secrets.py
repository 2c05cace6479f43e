"""Secret scans with multipart credential linking, in built-in functions only.

Strong spans (assignments, access identifiers, hexadecimal runs) are always reported. Weak candidates
(identifiers, secrets, endpoints that alone mean little) are reported only where complementary parts co-occur:
an identifier with a secret in its scope, a secret with an identifier, an endpoint with both. The scope of a
span reaches ``SCOPE`` code points past both ends; parts that overlap don't complement each other, and a weak
candidate that overlaps a strong span is left to that. The interval join of parts is a plane sweep inside the row:
all spans of a text in order, once forwards and once backwards, carrying the nearest end (or start) of each kind
that lies apart, so that no pair of spans is ever formed and no text is shuffled.

Positions are code points, ends exclusive. Java finds the same leftmost, non-overlapping matches for splitting
and for extracting, so the lengths of gaps and matches give the places.

Results for unusual rows: a null text counts as empty; a text without spans has counts of 0 and empty strings;
spans that start at one place come in the order of their kinds; a value ends where its run of characters does,
however long, and a very long text is held whole, with all its spans, by one task; repeated rows give repeated
results; an empty table gives an empty result; columns that clash with names of this module are replaced only
where the result names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns; a match stays if its second group, or else all of it, is long enough.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
#: ``AKIA[A-Z0-9]+`` of 18 or more and ``[0-9a-f]+`` of 16 or more: greedy runs, so a count says the same.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
BASE = ["assign", "access", "hex"]

#: Weak candidates, by kind; ``_START`` stands where no word goes on. Runs stay if they have exactly RUN_LENGTH.
_START = "(?<![A-Za-z0-9_])"
WEAK_ID = (
    rf"""(?i:{_START}(?:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{{3,}})"""
    rf"""|{_START}(?:ASIA|AGPA|AIDA|AROA|ANPA)[A-Z0-9]{{12,}}"""
)
WEAK_SECRET = rf"""(?i){_START}(?:pwd|pass|passphrase|auth|credentials?|private_?key|access_?key)["']?\x20*[:=]\x20*["']?[^\s"',;]{{6,}}"""
ENDPOINT = (
    rf"""(?i){_START}(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s?ftp|s3)://[^\s"'<>]+"""
    rf"""|{_START}(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{{4,}}"""
)
RUN, RUN_LENGTH = "[A-Za-z0-9+/=]{40,}", 40
KINDS = [*BASE, "link_id", "link_secret", "link_endpoint", "link_secret"]
SCOPE = 200
#: Items folded into one list before lists are put together.
CHUNK = 256
MARK = "<SECRET>"

_SPAN = "array<struct<start:int,rank:int,end:int>>"
_FAR = 1 << 30


def _none() -> Column:
    return F.array().cast(_SPAN)


def gathered(items: Column, state: dict[str, Column], kind: str, step) -> Column:
    """The arrays of type ``kind`` that ``step(acc, item)`` gives beside the next state, one after the other.

    ``items`` must be a column of the table, for it is read chunk by chunk: a list is copied as it grows, so short
    lists are built and then put together, and the cost stays near the number of items.
    """
    names = list(state)

    def inner(acc: Column, x: Column) -> Column:
        new, add = step(acc, x)
        return F.struct(*(new[k].alias(k) for k in names), F.concat(acc["out"], add).alias("out"))

    def outer(acc: Column, chunk: Column) -> Column:
        zero = F.struct(*(acc[k].alias(k) for k in names), F.array().cast(kind).alias("out"))
        return F.aggregate(chunk, zero, inner, lambda a: F.struct(*(a[k].alias(k) for k in names), F.concat(acc["outs"], F.array(a["out"])).alias("outs")))

    last = F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * CHUNK + 1, CHUNK))
    zero = F.struct(*(v.alias(k) for k, v in state.items()), F.array().cast(f"array<{kind}>").alias("outs"))
    whole = F.flatten(F.aggregate(chunks, zero, outer, lambda a: a["outs"]))
    return F.when(F.size(items) > 0, whole).otherwise(F.array().cast(kind))


def match_steps(text: Column, pattern: str, group: int = 0) -> Column:
    """Per match of ``pattern``: code points of the gap before it (g), of the match (m) and of ``group`` (s)."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else found
    steps = F.zip_with(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), sizes, lambda x, s: F.struct(x["g"].alias("g"), x["m"].alias("m"), s.alias("s")))
    steps = F.filter(steps, lambda x: x["m"].isNotNull())  # the gap after the last match
    return F.when(text.rlike(pattern), steps).otherwise(F.array().cast("array<struct<g:int,m:int,s:int>>"))


def spans(steps: Column, rank: int, least: int = 0, most: int = _FAR) -> Column:
    """Places of the matches whose group has ``least`` to ``most`` code points."""

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        start = acc["at"] + x["g"]
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + x["m"]).alias("end")))
        return {"at": start + x["m"]}, F.when(x["s"].between(least, most), span).otherwise(_none())

    return gathered(steps, {"at": F.lit(0)}, _SPAN, step)


def _apart(parts: Column, backwards: Column) -> Column:
    """``parts`` without the weak ones that a strong one overlaps; ``backwards`` are the same in reverse."""

    def step(forwards: bool):
        def one(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
            if forwards:
                over, strong = acc["b"] > x["start"], F.greatest(acc["b"], x["end"])
            else:
                over, strong = acc["b"] < x["end"], F.least(acc["b"], x["start"])
            return {"b": F.when(x["rank"] < 3, strong).otherwise(acc["b"])}, F.array(over)

        return one

    before = gathered(parts, {"b": F.lit(-_FAR)}, "array<boolean>", step(True))
    after = F.reverse(gathered(backwards, {"b": F.lit(_FAR)}, "array<boolean>", step(False)))
    over = F.zip_with(before, after, lambda a, b: a | b)
    marked = F.zip_with(parts, over, lambda x, o: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), o.alias("o")))
    kept = F.filter(marked, lambda x: (x["rank"] < 3) | ~x["o"])
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))


#: Kinds of weak parts that complement others, by role.
_ROLES = {"i": [3], "s": [4, 6]}


def _near(parts: Column, forwards: bool) -> Column:
    """Per part (start, rank, end, f): f is 1 if an identifier that lies apart is in scope on the side passed before, plus 2 for a secret.

    Forwards, ``parts`` come by start; backwards by end, the last first. Weak parts may overlap, but those of one
    kind don't: of each, the last two are carried, and one of them is the nearest that lies apart.
    """
    near, far = ("end", "start") if forwards else ("start", "end")

    def step(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        def gap(place: Column) -> Column:
            return x[far] - place if forwards else place - x[far]

        def in_scope(role: str) -> Column:
            found = gap(acc[role]) <= SCOPE
            for k in _ROLES[role]:
                last = acc[f"l{k}"]
                found |= gap(F.when(gap(last) >= 0, last).otherwise(acc[f"p{k}"])) <= SCOPE
            return found

        def carried(role: str, ranks: list[int]) -> Column:
            nearer = F.greatest(acc[role], x[near]) if forwards else F.least(acc[role], x[near])
            return F.when(x["rank"].isin(ranks), nearer).otherwise(acc[role])

        state = {"i": carried("i", [1]), "s": carried("s", [0, 2])}
        for k in (3, 4, 6):
            state[f"l{k}"] = F.when(x["rank"] == k, x[near]).otherwise(acc[f"l{k}"])
            state[f"p{k}"] = F.when(x["rank"] == k, acc[f"l{k}"]).otherwise(acc[f"p{k}"])
        f = F.when(in_scope("i"), 1).otherwise(0) + F.when(in_scope("s"), 2).otherwise(0)
        return state, F.array(F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), f.alias("f")))

    start = F.lit(-_FAR if forwards else _FAR)
    return gathered(parts, {k: start for k in ("i", "s", "l3", "p3", "l4", "p4", "l6", "p6")}, "array<struct<start:int,rank:int,end:int,f:int>>", step)


def linked(before: Column, after: Column) -> Column:
    """The strong spans, and the weak ones whose complementary parts are in scope: from both sweeps, in one order."""
    marked = F.zip_with(before, after, lambda a, b: F.struct(a["start"].alias("start"), a["rank"].alias("rank"), a["end"].alias("end"), a["f"].bitwiseOR(b["f"]).alias("f")))

    def stays(x: Column) -> Column:
        has_id, has_secret = x["f"].bitwiseAND(F.lit(1)) != 0, x["f"].bitwiseAND(F.lit(2)) != 0
        return (x["rank"] < 3) | F.when(x["rank"] == 3, has_secret).when(x["rank"] == 5, has_id & has_secret).otherwise(has_id)

    kept = F.filter(marked, stays)
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, in their order."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["rank"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with _text (null: empty), _assign, _access, _hex (strong spans), _base and _spans (all), in order."""
    t = F.col("_text")
    strong = [(ASSIGN, 0, 2, ASSIGN_LEAST, _FAR), (ACCESS, 1, 0, 0, _FAR), (HEX, 2, 0, 0, _FAR)]
    weak = [(WEAK_ID, 3, 0, 0, _FAR), (WEAK_SECRET, 4, 0, 0, _FAR), (ENDPOINT, 5, 0, 0, _FAR), (RUN, 6, 0, RUN_LENGTH, RUN_LENGTH)]
    every = [*strong, *weak]
    names = [f"_{k}" for k in BASE] + [f"_weak{r}" for _, r, *_ in weak]
    own = ["_parts", "_backwards", "_before", "_after"]
    parts, backwards = F.col("_parts"), F.col("_backwards")
    # A weak part needs another part; without any, the sweep has nothing to add.
    some = F.size("_parts") > F.greatest(F.size("_base"), F.lit(1))
    out = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({f"_m{r}": match_steps(t, p, g) for p, r, g, *_ in every})
    out = out.withColumns({c: spans(F.col(f"_m{r}"), r, least, most) for c, (_, r, _, least, most) in zip(names, every, strict=True)})
    out = out.withColumn("_base", F.array_sort(F.concat(*names[:3]))).withColumn("_parts", F.array_sort(F.concat("_base", *names[3:])))
    out = out.withColumn("_parts", F.when(some, parts).otherwise(_none())).withColumn("_backwards", F.reverse("_parts"))
    out = out.withColumn("_parts", F.when(F.size(parts) > 0, _apart(parts, backwards)).otherwise(_none()))
    by_end = F.reverse(F.array_sort(F.transform(parts, lambda x: F.struct(x["end"].alias("end"), x["rank"].alias("rank"), x["start"].alias("start")))))
    out = out.withColumn("_backwards", F.transform(by_end, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"))))
    out = out.withColumns({"_before": _near(parts, True), "_after": _near(backwards, False)})
    out = out.withColumn("_spans", F.when(F.size("_parts") > 0, linked(F.col("_before"), F.array_sort("_after"))).otherwise(F.col("_base")))
    return out.drop(*own, *names[3:], *(f"_m{r}" for _, r, *_ in every))


def digests(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with n_assign, n_access, n_hex, base_sha256 and spans per row."""
    found = scan_documents(docs.select(*keep, "text"))
    return found.select(
        *keep,
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(F.col("_base")), 256).alias("base_sha256"),
        joined(F.col("_spans")).alias("spans"),
    )


def _merged(spans: Column) -> Column:
    """Disjoint spans that cover the same places: each span's start where no earlier one reaches it, with the furthest end until then.

    The last of ``spans`` only closes the one before.
    """

    def opens(acc: Column, x: Column) -> tuple[dict[str, Column], Column]:
        new = x["start"] > acc["end"]
        start = F.when(new, x["start"]).otherwise(acc["start"])
        end = F.when(new, x["end"]).otherwise(F.greatest(acc["end"], x["end"]))
        closed = F.array(F.struct(acc["start"].alias("start"), F.lit(0).alias("rank"), acc["end"].alias("end")))
        return {"start": start, "end": end}, F.when(new & (acc["start"] >= 0), closed).otherwise(_none())

    return gathered(spans, {"start": F.lit(-1), "end": F.lit(-1)}, _SPAN, opens)


def redacted(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``, and n_chars, if there, counted anew.

    A text without spans, null included, stays as it is.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    far = F.array(F.struct(F.lit(_FAR).alias("start"), F.lit(0).alias("rank"), F.lit(_FAR).alias("end")))
    found = scan_documents(packed).withColumn("_closed", F.when(F.size("_spans") > 0, F.concat("_spans", far)))
    found = found.withColumn("_cut", F.when(F.col("_closed").isNotNull(), _merged(F.col("_closed"))))
    cut, t = F.col("_cut"), F.col("_text")

    def part(i: Column) -> Column:
        """Some spans, where the text before them begins, and the text up to the last of them."""
        some = F.slice(cut, i * CHUNK + 1, CHUNK)
        begin = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(cut, i * CHUNK)["end"])
        return F.struct(some.alias("cut"), begin.alias("begin"), F.substr(t, begin + 1, F.element_at(some, -1)["end"] - begin).alias("text"))

    def pieces(p: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            before = F.when(i == 0, p["begin"]).otherwise(F.try_element_at(p["cut"], i)["end"])
            return F.concat(F.substr(p["text"], before - p["begin"] + 1, x["start"] - before), F.lit(mark))

        return F.transform(p["cut"], piece)

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(cut) - 1) / CHUNK).cast("int")), part)
    tail = F.substr(t, F.element_at(cut, -1)["end"] + 1)
    whole = F.concat(F.array_join(F.flatten(F.transform(parts, pieces)), ""), tail)
    out = found.select("_row", F.when(cut.isNotNull(), whole).otherwise(F.col("text")).alias("text"), cut.isNotNull().alias("_new"))

    def column(c: str) -> Column:
        if c == "text":
            return F.col("text")
        old = F.col("_row")[c]
        if c == "n_chars":
            return F.when(F.col("_new"), F.length("text").cast(docs.schema[c].dataType)).otherwise(old).alias(c)
        return old.alias(c)

    return out.select(*map(column, docs.columns))
