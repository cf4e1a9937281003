r"""Chat formatting with a checked round trip.

Template, per turn in turn order:

    <|im_start|>ROLE\nTEXT<|im_end|>\n

Escaping puts one backslash more behind the `<` of anything that looks like a control string
with any number of backslashes (`<|im_end|>` becomes `<\|im_end|>`, that becomes
`<\\|im_end|>`); unescaping takes one away. In a role a backslash is doubled and a line
feed written `\n` too. The parser always unescapes. A conversation is rendered as it is and parsed;
where what comes back differs from the source, the turns are rendered escaped and parsed
again. Escaped text holds no control string and unescapes to itself, so this ends with the
first escaping; a conversation that still differed would raise an error.

A conversation is one training sample and one value, because its digest runs over all its
text; nothing larger is gathered. Built-in functions only.

Rows: null text or role counts as empty; turns with equal numbers go by role, then text;
repeated rows are turns; a null `turn` comes first; a null `conv_id` is a conversation of
its own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = r"<(\\*)\|(im_start|im_end)\|>"
ESCAPED = r"<\\(\\*)\|(im_start|im_end)\|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"<\\$1|$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "<$1|$2|>")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    halves = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(halves, lambda h: F.replace(h, F.lit("\\n"), F.lit("\n"))), "\\")


def render(turns: Column, escaped: bool) -> Column:
    def one(t: Column) -> Column:
        text = escape(t["text"]) if escaped else t["text"]
        return F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), text, F.lit(END + "\n"))

    return F.array_join(F.transform(turns, one), "")


def parse(formatted: Column) -> Column:
    """Turns (role, text) of a formatted conversation. Anything out of place, such as text
    behind an end mark, leaves a turn whose text is null."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)

    def one(part: Column) -> Column:
        head = F.instr(part, "\n")
        body = F.substring(part, head + F.lit(1), F.length(part))
        stop = F.instr(body, END)
        whole = (head > 0) & (stop > 0) & (stop == F.length(body) - F.lit(len(END)))
        return F.struct(
            unescape_role(F.substring(part, F.lit(1), head - F.lit(1))).alias("role"),
            F.when(whole, unescape(F.substring(body, F.lit(1), stop - F.lit(1)))).alias("text"),
        )

    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one)


def format_conversations(rows: DataFrame) -> DataFrame:
    """Per conversation: `conv_id`, `formatted`, `turns` as parsed from it, `escaped`."""
    turns = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("_turn"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    source = grouped.select("conv_id", F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("_turns"))
    plain = source.select("*", render(F.col("_turns"), escaped=False).alias("_plain"))
    tried = plain.select("*", (parse(F.col("_plain")) == F.col("_turns")).alias("_same"))
    settled = tried.select(
        "conv_id",
        "_turns",
        (~F.col("_same")).alias("escaped"),
        F.when(F.col("_same"), F.col("_plain")).otherwise(render(F.col("_turns"), escaped=True)).alias("formatted"),
    )
    parsed = settled.select("*", parse(F.col("formatted")).alias("turns"))
    checked = F.when(parsed["turns"] == parsed["_turns"], F.col("turns")).otherwise(
        F.raise_error(F.concat(F.lit("round trip failed for conversation "), F.col("conv_id").cast("string"))).cast(parsed.schema["turns"].dataType)
    )
    return parsed.select("conv_id", "formatted", checked.alias("turns"), "escaped")


def loss_spans(turns: Column) -> Column:
    """Texts under the loss mask: those of the assistant, in order."""
    return F.transform(F.filter(turns, lambda t: t["role"] == "assistant"), lambda t: t["text"])


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what `format_conversations` gave."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = formatted.select("*", F.array_join(loss_spans(F.col("turns")), "").alias("_loss"))
    return loss.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
