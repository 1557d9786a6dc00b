"""Chat formatting with typed content parts, in built-in functions only.

A message's content is an array of typed parts: text, image, audio or document. The visitor turns
each part into text: a text part into its text, escaped; an attachment into an ordered placeholder
``<|image:K|>`` where K counts the attachments of the conversation from 1, while the attachment's
reference and the number of tokens that the placeholder stands for are recorded beside the text.

A turn is ``<|turn|>role\\ntext<|end|>\\n``. Control strings inside texts are escaped reversibly: a
backslash is put after each "<" or "[" that a control string may start with, that a backslash follows
or that ends its part. So no escaped text holds a control string, alone or with its neighbours, and
taking one backslash away after each gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import let

TURN, END = "<|turn|>", "<|end|>\n"

#: How control strings go on after their first character, "<" or "[". The template's own
#: marks begin "<|"; other chat templates' are <s>, </s>, [INST], [/INST], <<SYS>> and <</SYS>>.
_PLAIN = r"([<\[])(\\+|(?=[|/sSI<]|\z))"
_ESCAPED = r"([<\[])\\"

#: Tokens that an attachment stands for: an image has one for each square of so many pixels a side,
#: audio so many a second, a document so many a page.
IMAGE_SIDE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256

#: The parts of a message.
PART = "struct<kind:string,text:string,ref:string,width:long,height:long,seconds:double,pages:long>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1")


def escape_role(role: Column) -> Column:
    """A role is one line: a backslash becomes \\b and a line end \\n."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\b")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """The content array of a message that is only text."""
    null = F.lit(None)
    fields = [F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref")]
    fields += [null.cast("long").alias("width"), null.cast("long").alias("height"), null.cast("double").alias("seconds"), null.cast("long").alias("pages")]
    return F.array(F.struct(*fields))


def part_tokens(part: Column) -> Column:
    """Tokens that an attachment's placeholder expands to; one where its size is not known; text has 0."""
    side = lambda x: F.ceil(x / IMAGE_SIDE)
    return (
        F.when(part["kind"] == "text", 0)
        .when(part["kind"] == "image", F.coalesce(side(part["width"]) * side(part["height"]), F.lit(1)))
        .when(part["kind"] == "audio", F.coalesce(F.ceil(part["seconds"] * AUDIO_RATE), F.lit(1)))
        .when(part["kind"] == "document", F.coalesce(part["pages"] * PAGE_TOKENS, F.lit(1)))
        .otherwise(1)
        .cast("long")
    )


def _is_text(part: Column) -> Column:
    return part["kind"].isNull() | (part["kind"] == "text")


def format_chats(messages: DataFrame, train_role: str = "assistant") -> DataFrame:
    """One row for each conv_id of ``messages`` (conv_id, turn, role, parts).

    conv_id, n_turns, formatted (the text), turns (array, by turn, of chars: code points of the turn
    in ``formatted``, and of the span under the loss mask: loss_from within the turn, loss_chars,
    both 0 for other roles), attachments (array by ordinal of ordinal, kind, ref, n_tokens) and
    n_attachment_tokens.

    Turns go by turn, null first, and equal turns by role and text; repeated rows are turns too. Null
    roles and texts count as empty, null parts as no part, an unknown kind as an attachment of that
    kind. Rows with a null conv_id form one conversation. Other columns are not read; an empty table
    gives no rows. A conversation is one row of the result whatever its length.
    """
    kind = lambda p: F.regexp_replace(F.coalesce(p["kind"], F.lit("text")), "[^A-Za-z0-9_]", "_")
    parts = F.filter(F.coalesce("parts", F.expr(f"cast(array() as array<{PART}>)")), lambda p: p.isNotNull())
    role = F.coalesce(F.col("role"), F.lit(""))
    plain = F.array_join(F.transform(parts, lambda p: F.when(_is_text(p), F.coalesce(p["text"], F.lit(""))).otherwise(F.lit(""))), "")
    each = messages.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), plain.alias("plain"), parts.alias("parts")).alias("m"))
    chats = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    loose = F.filter(F.flatten(F.transform("ms", lambda m: m["parts"])), lambda p: ~_is_text(p))
    attachments = F.transform(loose, lambda p, i: F.struct((i + 1).alias("ordinal"), kind(p).alias("kind"), p["ref"].alias("ref"), part_tokens(p).alias("n_tokens")))
    chats = chats.select("conv_id", "ms", attachments.alias("attachments"))
    # the number of attachments before each turn is only worked out where there are any
    counts = F.transform("ms", lambda m: F.size(F.filter(m["parts"], lambda p: ~_is_text(p))))
    before = F.when(F.size("attachments") == 0, F.array_repeat(F.lit(0), F.size("ms"))).otherwise(
        let(counts, lambda c: F.transform(c, lambda x, i: F.aggregate(F.slice(c, 1, i), F.lit(0), lambda a, y: a + y)))
    )

    def body(m: Column, first: Column) -> Column:
        marked = F.transform(m["parts"], lambda p, i: F.struct(p.alias("p"), (F.size(F.filter(F.slice(m["parts"], 1, i), lambda q: ~_is_text(q)))).alias("k")))
        shown = F.transform(
            marked,
            lambda x: F.when(_is_text(x["p"]), escape(F.coalesce(x["p"]["text"], F.lit("")))).otherwise(
                F.concat(F.lit("<|"), kind(x["p"]), F.lit(":"), (first + x["k"] + 1).cast("string"), F.lit("|>"))
            ),
        )
        only = F.element_at(m["parts"], 1)["text"]
        return F.when((F.size(m["parts"]) == 1) & _is_text(F.element_at(m["parts"], 1)), escape(F.coalesce(only, F.lit("")))).otherwise(F.array_join(shown, ""))

    pieces = F.zip_with("ms", before, lambda m, k: F.struct(F.concat(F.lit(TURN), escape_role(m["role"]), F.lit("\n")).alias("head"), body(m, k).alias("body"), (m["role"] == train_role).alias("train")))
    chats = chats.select("conv_id", "attachments", F.size("ms").cast("long").alias("n_turns"), pieces.alias("pieces"))
    none = F.lit(0)
    spans = F.transform(
        "pieces",
        lambda p: F.struct(
            (F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("chars"),
            F.when(p["train"], F.length(p["head"])).otherwise(none).alias("loss_from"),
            F.when(p["train"], F.length(p["body"])).otherwise(none).alias("loss_chars"),
        ),
    )
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    tokens = F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"])
    return chats.select("conv_id", "n_turns", formatted.alias("formatted"), spans.alias("turns"), "attachments", tokens.alias("n_attachment_tokens"))


#: A placeholder in an escaped text, where nothing else begins "<|".
_PLACEHOLDER = r"<\|([A-Za-z0-9_]+:[0-9]+)\|>"


def read_chats(chats: DataFrame) -> DataFrame:
    """What ``formatted`` and its mask hold: conv_id, roles, texts (unescaped, with placeholders), bare_texts
    (without them), placeholders ("kind:ordinal", in order) and loss_text."""
    ended = F.split("formatted", r"<\|end\|>\n")
    turns = F.slice(ended, 1, F.size(ended) - 1)
    rows = chats.select("*", F.zip_with(turns, F.col("turns"), lambda t, s: F.struct(t.alias("t"), s.alias("s"))).alias("z"))
    head = lambda t: F.substring_index(t, "\n", 1)
    roles = F.transform("z", lambda z: unescape_role(head(z["t"]).substr(F.lit(len(TURN) + 1), F.length(head(z["t"])))))
    body = lambda z: z["t"].substr(F.length(head(z["t"])) + 2, F.length(z["t"]))
    texts = F.transform("z", lambda z: unescape(body(z)))
    bare = F.transform("z", lambda z: unescape(F.regexp_replace(body(z), _PLACEHOLDER, "")))
    loss = F.transform(F.filter("z", lambda z: z["s"]["loss_chars"] > 0), lambda z: unescape(z["t"].substr(z["s"]["loss_from"] + 1, z["s"]["loss_chars"])))
    kept = [c for c in chats.columns if c in ("attachments", "n_attachment_tokens")]
    return rows.select("conv_id", "formatted", *kept, roles.alias("roles"), texts.alias("texts"), bare.alias("bare_texts"), F.regexp_extract_all("formatted", F.lit(_PLACEHOLDER), F.lit(1)).alias("placeholders"), F.array_join(loss, "").alias("loss_text"))


def document_part(ref: Column, pages: Column) -> Column:
    """A document's part as an array, empty where ``ref`` is null."""
    null = F.lit(None)
    fields = [F.lit("document").alias("kind"), null.cast("string").alias("text"), ref.alias("ref"), null.cast("long").alias("width"), null.cast("long").alias("height"), null.cast("double").alias("seconds"), pages.cast("long").alias("pages")]
    return F.filter(F.array(F.struct(*fields)), lambda p: p["ref"].isNotNull())


def messages_of(conversations: DataFrame, attached: Column | None = None) -> DataFrame:
    """(conv_id, turn, role, parts) of rows (conv_id, turn, role, text): a text part, then the parts ``attached``."""
    parts = text_part(F.col("text"))
    return conversations.select("conv_id", "turn", "role", (parts if attached is None else F.concat(parts, attached)).alias("parts"))
