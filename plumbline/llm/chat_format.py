"""Chat formatting from a declarative template, in DataFrame functions.

The turns of a conversation pass through a finite-state machine over roles, which tells whether their order is
valid. Whatever it says, the conversation is emitted as segments of text, each with a flag that says whether loss is
taken on it; the state in which the machine ends is returned beside them. Texts can't forge the template's control
strings: these and the escape sign itself are escaped, and parse() gives the very turns back.

Defined results: turns are ordered by turn, role and text, nulls first; a null text or role is read as empty; a role
the machine doesn't know ends in the state "bad"; repeated rows are turns of their own; rows with a null conv_id make
one conversation; no rows give no rows. A conversation is one row, so it must fit one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let, table, written


@dataclass(frozen=True)
class Template:
    """A turn is open, role, after_role, text, close. What must be escaped follows from these three strings."""

    open: str = "### "
    after_role: str = ": "
    close: str = "</turn>\n"
    learn: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user",
    })

    def __post_init__(self) -> None:
        if not self.close.strip() or not self.after_role.strip():
            raise ValueError("a template needs something to tell roles, texts and turns apart")
        if "\\" in self.open + self.after_role + self.close:
            raise ValueError("the backslash is the escape sign")

    def _letters(self, *controls: str) -> tuple[tuple[str, str], ...]:
        """Letters that no control string holds, so that an escaped one can't be part of another."""
        free = (c for c in "htcabdefgijklmnopqrsuvwxyz0123456789" if c not in self.open + self.after_role + self.close)
        return tuple((x, next(free)) for x in dict.fromkeys(c.strip() for c in controls) if x)

    @property
    def role_escapes(self) -> tuple[tuple[str, str], ...]:
        """What is escaped in a role, and the letter that stands for it after a backslash; the backslash is doubled."""
        return self._letters(self.open, self.close, self.after_role)

    @property
    def escapes(self) -> tuple[tuple[str, str], ...]:
        """The same for a text, which may hold what ends a role, as roles can't."""
        return tuple(x for x in self.role_escapes if x[0] != self.after_role.strip() or x[0] in (self.open.strip(), self.close.strip()))


def quoted(literal: str) -> str:
    """A string as a regular expression for itself."""
    return "\\Q" + literal.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def escape(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for what, letter in pairs:
        text = F.replace(text, F.lit(what), F.lit("\\" + letter))
    return text


def unescape(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Doubled backslashes are told apart first, from the left; between them every backslash begins a letter."""

    def plain(x: Column) -> Column:
        for what, letter in pairs:
            x = F.replace(x, F.lit("\\" + letter), F.lit(what))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def end_state(turns: Column, t: Template) -> Column:
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}>{role}", to)])
    step = lambda state, turn: F.coalesce(F.try_element_at(moves, F.concat_ws(">", state, turn["role"])), F.lit("bad"))
    return F.aggregate(turns, F.lit(t.start), step)


def format_chats(rows: DataFrame, t: Template = Template()) -> DataFrame:
    """conv_id, state, valid, segments: array of (text, loss), whose texts in order are the formatted conversation."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def segments(x: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(F.lit(t.open), escape(x["role"], t.role_escapes), F.lit(t.after_role))
        return F.array(piece(head, F.lit(False)), piece(escape(x["text"], t.escapes), x["role"].isin(*t.learn)), piece(F.lit(t.close), F.lit(False)))

    return chats.select("conv_id", end_state(F.col("turns"), t).alias("state"), F.flatten(F.transform("turns", segments)).alias("segments")).withColumn("valid", F.col("state").isin(*t.accept))


def parse(formatted: Column, t: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, quoted(t.close), -1)

    def turn(x: Column) -> Column:
        body = F.substr(x, F.lit(len(t.open) + 1))
        return let(body, lambda b: let(F.substring_index(b, t.after_role, 1), lambda role: F.struct(unescape(role, t.role_escapes).alias("role"), unescape(F.substr(b, F.length(role) + len(t.after_role) + 1), t.escapes).alias("text"))))

    return let(parts, lambda p: F.transform(F.slice(p, 1, F.size(p) - 1), turn))


def digests(chats: DataFrame, t: Template = Template()) -> DataFrame:
    """What the formatted conversations hold, read back from them."""
    read = chats.select("conv_id", "state", "valid", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"))
    turns = let(parse(F.col("formatted"), t), lambda p: F.struct(F.size(p).cast("long").alias("n"), F.sha2(F.array_join(F.transform(p, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("sha")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"], t.escapes)), "")
    loss = let(loss, lambda x: F.struct(F.length(x).cast("long").alias("n"), F.sha2(x, 256).alias("sha")))
    read = read.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "state", "valid")
    return read.select("conv_id", F.col("turns.n").alias("n_turns"), F.col("turns.sha").alias("turns_sha256"), F.col("loss.n").alias("loss_chars"), F.col("loss.sha").alias("loss_sha256"), "formatted_chars", "state", "valid")


PROBE = "\\### Assistant: </turn> ok"


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PROBE))
    return digests(written(format_chats(rows.union(probe)), "chats"))


OP9_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\t'), ':', '\c')) + length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t')) + 14 AS n,
             lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev FROM r),
f AS (SELECT *, (prev || '>' || role) NOT IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS wrong FROM e),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(n)::BIGINT AS formatted_chars,
             CASE WHEN bool_or(wrong) THEN 'bad' ELSE list(role ORDER BY turn NULLS FIRST, role, text)[-1] END AS state FROM f GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, state, state = 'assistant' AS valid FROM g
"""
