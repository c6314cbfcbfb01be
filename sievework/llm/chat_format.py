"""Chat formatting: a finite-state machine over roles and a declarative template."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RoleFormat:
    """Text before and after a turn, and whether the turn's text and end are trained on."""

    before: str
    after: str
    loss: bool


@dataclass(frozen=True)
class Template:
    roles: Mapping[str, RoleFormat]
    begin: str = ""
    end: str = ""
    next_roles: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    final: tuple[str, ...] = ("assistant",)


CHATML = Template(
    roles={
        "system": RoleFormat("<|im_start|>system\n", "<|im_end|>\n", False),
        "user": RoleFormat("<|im_start|>user\n", "<|im_end|>\n", False),
        "assistant": RoleFormat("<|im_start|>assistant\n", "<|im_end|>\n", True),
    },
    next_roles={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant", "user"),
)


def _literal_map(pairs: Mapping[str, str]) -> F.Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def format_chats(conversations: DataFrame, template: Template = CHATML, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, seg, text, loss, error): a conversation's segments in order, their texts to be joined.

    Each turn gives three segments: what the template puts before it (never
    trained on), its text and what comes after it (trained on where the role
    is); the template's begin and end, where not empty, one each. A
    conversation that the machine rejects gives one row, seg and text null,
    with the error: ``repeated turn`` (two rows of one turn number, or a null
    one), ``unknown role`` (also null), ``turn order`` or ``final role``, the
    first that applies. A null text is empty. Rows with a null id are left
    out. A turn's place is its number, not its row's; other columns are
    ignored; an empty table gives no rows. Whole conversations are sorted and
    run through the machine inside the JVM, after the one shuffle by id.
    """
    turns = conversations.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t")).where("conv_id IS NOT NULL")
    chats = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    moves = _literal_map({f"{a}>{b}": b for a, bs in template.next_roles.items() for b in bs})
    state = F.aggregate("t", F.lit("start"), lambda s, x: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit(">"), x["role"])), F.lit("reject")))
    numbers = F.transform("t", lambda x: x["turn"])
    error = (
        F.when((F.size(F.array_distinct(numbers)) != F.size("t")) | F.exists(numbers, lambda n: n.isNull()), "repeated turn")
        .when(F.exists("t", lambda x: ~F.coalesce(x["role"].isin(list(template.roles)), F.lit(False))), "unknown role")
        .when(F.col("state") == "reject", "turn order")
        .when(~F.col("state").isin(list(template.final)), "final role")
    )
    before = _literal_map({k: v.before for k, v in template.roles.items()})
    after = _literal_map({k: v.after for k, v in template.roles.items()})
    loss = F.create_map(*[F.lit(x) for k, v in template.roles.items() for x in (k, v.loss)])
    piece = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    no = F.lit(False)
    body = F.flatten(F.transform("t", lambda x: F.array(piece(F.try_element_at(before, x["role"]), no), piece(x["text"], F.try_element_at(loss, x["role"])), piece(F.try_element_at(after, x["role"]), F.try_element_at(loss, x["role"])))))
    ends = [F.array(piece(F.lit(x), no)) if x else None for x in (template.begin, template.end)]
    segments = F.concat(*[x for x in (ends[0], body, ends[1]) if x is not None])
    judged = chats.withColumn("state", state).withColumn("error", error)
    rejected = F.array(piece(F.lit(None).cast("string"), F.lit(None).cast("boolean")))
    rows = judged.select("conv_id", "error", F.posexplode(F.when(F.col("error").isNull(), segments).otherwise(rejected)).alias("seg", "s"))
    return rows.select("conv_id", F.when(F.col("error").isNull(), F.col("seg")).alias("seg"), F.col("s.text").alias("text"), F.col("s.loss").alias("loss"), "error")
