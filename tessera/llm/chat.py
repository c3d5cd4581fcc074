"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs and sorted, the texts of adjacent
turns of one role are gathered in one array and that array is folded into one
block, and the blocks are concatenated:

    [INST]text[+]text[/INST]<s>text</s>[ROLE system]text[/ROLE]

Users have [INST], assistants <s>, any other role [ROLE name] with its name
URL-encoded; [+] stands between the turns of a block. A control string inside a
text gets one more backslash after its first character than it had, so the
format can be read back exactly. The loss mask is the list of character ranges
of the assistants' texts in the formatted string.

Nulls and edges: a null text or role is an empty one; rows with a null
conversation form one conversation of their own, null; null turns come first;
equal turns are ordered by role, then text, and repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings, to be escaped inside texts: a first character, backslashes, the rest.
_CONTROL = r"([\[<])(\\*)(/?INST\]|/?s>|ROLE |/ROLE\]|\+\])"
_ESCAPED = r"([\[<])\\(\\*)(/?INST\]|/?s>|ROLE |/ROLE\]|\+\])"
_BLOCK = r"(?s)(\[INST\]|<s>|\[ROLE [^\]]*\])(.*?)(?:\[/INST\]|</s>|\[/ROLE\])"

#: Turns whose sizes are added up one by one.
CHUNK = 128


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def opening(role: Column) -> Column:
    return (
        F.when(role == "user", F.lit("[INST]"))
        .when(role == "assistant", F.lit("<s>"))
        .otherwise(F.concat(F.lit("[ROLE "), F.url_encode(role), F.lit("]")))
    )


def closing(role: Column) -> Column:
    return F.when(role == "user", F.lit("[/INST]")).when(role == "assistant", F.lit("</s>")).otherwise(F.lit("[/ROLE]"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, though use may name it many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(turns: Column) -> Column:
    """role, bodies (escaped texts) of every run of turns with one role."""
    n = F.size(turns)
    role = lambda i: F.get(turns, i)["role"]
    firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))
    return _let(
        firsts,
        lambda at: F.transform(
            at,
            lambda i, k: F.struct(
                role(i).alias("role"),
                F.transform(F.slice(turns, i + 1, F.coalesce(F.get(at, k + 1), n) - i), lambda t: t["body"]).alias("bodies"),
            ),
        ),
    )


def _spans(turns: Column) -> Column:
    """first, length of the assistants' bodies in the formatted string.

    Where a turn begins is the sum of all sizes before it: of the chunks of CHUNK
    turns before its own, and of the turns before it in its own.
    """
    whole = lambda c: F.length(c).cast("long")

    def lead(i: Column) -> Column:
        own, before = F.get(turns, i)["role"], F.get(turns, i - 1)["role"]
        return F.when(i == 0, whole(opening(own))).when(before == own, F.lit(3).cast("long")).otherwise(whole(closing(before)) + whole(opening(own)))

    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)
    sizes = F.transform(turns, lambda t, i: lead(i) + whole(t["body"]))
    sums = lambda each: F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(each) / CHUNK).cast("int") - 1), lambda c: total(F.slice(each, c * CHUNK + 1, F.lit(CHUNK)))
    )
    befores = lambda chunks: F.transform(chunks, lambda _, c: total(F.slice(chunks, F.lit(1), c)))
    spoken = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: F.get(turns, i)["role"] == "assistant")
    span = lambda each, before, i: F.struct(
        (F.get(before, F.floor(i / CHUNK).cast("int")) + total(F.slice(each, F.floor(i / CHUNK).cast("int") * CHUNK + 1, i % CHUNK)) + lead(i)).alias("first"),
        whole(F.get(turns, i)["body"]).alias("length"),
    )
    return _let(sizes, lambda each: _let(_let(sums(each), befores), lambda before: F.transform(spoken, lambda i: span(each, before, i))))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (first character from 0, and length) of conv_id, turn, role, text rows."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    escaped = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("body")))
    written = lambda b: F.concat(opening(b["role"]), F.array_join(b["bodies"], "[+]"), closing(b["role"]))
    told = _let(
        escaped, lambda each: F.struct(F.array_join(F.transform(_blocks(each), written), "").alias("formatted"), _spans(each).alias("loss_spans"))
    )
    return sorted_turns.select("conv_id", told.alias("told")).select("conv_id", "told.*")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) and loss_text of formatted conversations."""
    heads = F.regexp_extract_all("formatted", F.lit(_BLOCK), F.lit(1))
    bodies = F.regexp_extract_all("formatted", F.lit(_BLOCK), F.lit(2))
    role = lambda head: (
        F.when(head == "[INST]", F.lit("user"))
        .when(head == "<s>", F.lit("assistant"))
        .otherwise(F.url_decode(F.substring(head, F.lit(7), F.length(head) - 7)))
    )
    turns = F.flatten(
        F.transform(
            F.arrays_zip(heads.alias("head"), bodies.alias("body")),
            lambda b: F.transform(
                F.split(b["body"], r"\[\+\]"), lambda t: F.struct(role(b["head"]).alias("role"), unescape(t).alias("text"))
            ),
        )
    )
    loss = F.array_join(
        F.transform(
            "loss_spans",
            lambda s: unescape(F.substring("formatted", (s["first"] + 1).cast("int"), s["length"].cast("int"))),
        ),
        "",
    )
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))


def report(turns: DataFrame) -> DataFrame:
    """One row per conversation: its turns and loss text read back from the formatted string, as digests."""
    back = read_back(format_conversations(turns))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
