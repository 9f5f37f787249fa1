"""Chat formatting in Spark expressions only.

A conversation becomes one text. Adjacent turns of one role share a block:

    <turn:ROLE>
    first text<+>second text</turn>

Inside texts and roles every control character of the template is escaped, so a text that
looks like a turn mark can't be read as one: ``\\`` becomes ``\\s`` and ``<`` becomes ``\\l``;
in roles also ``>`` becomes ``\\g`` and a line feed ``\\n``. Undoing the replacements in
reverse gives the text back, whatever it holds. ``loss_mask`` runs along the formatted text
as (chars, loss): the texts of the trained role are under the loss, the marks are not.

Defined results: turns go by ``turn`` (null last), ties by role and text; a null text or role
is empty; conv_id null is a conversation of its own; an empty table gives an empty result.
A conversation is one row of the result, so it is gathered in one task, and everything done
there is linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LOSS_ROLE = "assistant"
OPEN, NAMED, SEP, CLOSE = "<turn:", ">\n", "<+>", "</turn>\n"


def _swap(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


_TEXT = (("\\", "\\s"), ("<", "\\l"))
_ROLE = (*_TEXT, (">", "\\g"), ("\n", "\\n"))


def _undo(c: Column, pairs) -> Column:
    return _swap(c, [(new, old) for old, new in reversed(pairs)])


def format_chats(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, loss_mask) from (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    packed = F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    sorted_turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(packed)).alias("t"))
    n = F.size("t")
    t = F.col("t")

    def pieces(x: Column, i: Column) -> Column:
        starts = (i == 0) | (F.get(t, i - 1).role != x.role)
        ends = (i == n - 1) | (F.get(t, i + 1).role != x.role)
        before = F.when(starts, F.concat(F.lit(OPEN), _swap(x.role, _ROLE), F.lit(NAMED))).otherwise(F.lit(""))
        after = F.when(ends, F.lit(CLOSE)).otherwise(F.lit(SEP))
        return F.struct(before.alias("before"), _swap(x.text, _TEXT).alias("text"), after.alias("after"), (x.role == loss_role).alias("loss"))

    merged = sorted_turns.select("conv_id", F.transform(t, pieces).alias("p"))
    formatted = F.array_join(F.transform("p", lambda p: F.concat(p.before, p.text, p.after)), "")

    def runs(p: Column) -> Column:
        return F.array(*[F.struct(F.char_length(c).alias("chars"), loss.alias("loss")) for c, loss in ((p.before, F.lit(False)), (p.text, p.loss), (p.after, F.lit(False)))])

    return merged.select("conv_id", formatted.alias("formatted"), F.filter(F.flatten(F.transform("p", runs)), lambda r: r.chars > 0).alias("loss_mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_text): turns parsed from ``formatted`` alone, and the texts that lie under ``loss_mask``.

    The parsed marks and texts are the mask's runs, in order and of the same lengths; a mask that doesn't fit its text is an error.
    """
    blocks = F.split("formatted", CLOSE)
    blocks = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))

    def turns(block: Column) -> Column:
        halves = F.split(block, NAMED, 2)
        role = _undo(F.substr(F.get(halves, F.lit(0)), F.lit(len(OPEN) + 1)), _ROLE)
        texts = F.split(F.get(halves, F.lit(1)), "<\\+>")
        before = lambda i: F.when(i == 0, F.char_length(F.get(halves, F.lit(0))) + len(NAMED)).otherwise(F.lit(0))
        after = lambda i: F.when(i == F.size(texts) - 1, F.lit(len(CLOSE))).otherwise(F.lit(len(SEP)))
        return F.transform(texts, lambda x, i: F.struct(role.alias("role"), _undo(x, _TEXT).alias("text"), before(i).alias("before"), F.char_length(x).alias("chars"), after(i).alias("after")))

    def runs(t: Column) -> Column:
        mark = lambda chars: F.struct(chars.alias("chars"), F.lit(None).cast("string").alias("text"))
        return F.array(mark(t.before), F.struct(t.chars.alias("chars"), t.text.alias("text")), mark(t.after))

    def under(found: Column, masked: Column) -> Column:
        wrong = F.raise_error(F.lit("the loss mask doesn't fit its text")).cast("string")
        return F.when(found.chars.eqNullSafe(masked.chars), F.when(masked.loss, found.text)).otherwise(wrong)

    parsed = chats.select("conv_id", "formatted", "loss_mask", F.flatten(F.transform(blocks, turns)).alias("t"))
    found = F.filter(F.flatten(F.transform("t", runs)), lambda r: r.chars > 0)
    loss_text = F.array_join(F.zip_with(found, "loss_mask", under), "")
    return parsed.select("conv_id", "formatted", F.transform("t", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"), loss_text.alias("loss_text"))
