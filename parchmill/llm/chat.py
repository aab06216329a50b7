"""Chat formatting with typed content parts.

A conversation's rows are turns; a turn's content is an array of parts (``PART``). A visitor flattens each turn into
pieces in order: a head with the role, then escaped text or a placeholder for each part, then an end. Running
lengths over the pieces give every text of a trained role its span in the loss mask and every image, audio and document
its place, reference and number of tokens that its placeholder expands to. Everything is DataFrame functions.

Control strings inside texts and roles are escaped reversibly: a backslash goes after the string's first character, one
more where there are some already. No control string holds its first character or a backslash again, so the escaped text holds none,
none arises across pieces, and removing one backslash gives the text back.

Defined cases: a null text or role is empty; null parts are no parts; a part of no kind is text, one of an unknown kind an
attachment of one token; sizes that are null or not positive give the kind's least tokens; turns go by turn (null last),
then role, then content, and repeated rows are turns each; a null conv_id is a conversation like any other; a conversation
is one row, so it has to fit one (2 GB); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART = "struct<kind string, text string, ref string, width int, height int, seconds double, pages int>"
PARTS = f"array<{PART}>"


@dataclass(frozen=True)
class Template:
    """Marks of turns and attachments, further control strings to escape, roles under the loss mask, and sizes of attachments in tokens."""

    head: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    placeholders: dict[str, str] = field(default_factory=lambda: {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"})
    other: str = "<|attachment|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")
    trained: tuple[str, ...] = ("assistant",)
    #: pixels of an image tile's side and most tiles, audio tokens a second, tokens of a document page
    tile: int = 28
    most_tiles: int = 16384
    per_second: float = 25.0
    per_page: int = 1024

    def __post_init__(self):
        for c in self.controls:
            if len(c) < 2 or any(x in c[1:] for x in self.leads + "\\"):
                raise ValueError(f"control string {c!r}: its rest may hold no backslash and no first character of a control string")

    @property
    def controls(self) -> list[str]:
        return [self.head, self.middle, self.end, *self.placeholders.values(), self.other, *self.foreign]

    @property
    def leads(self) -> str:
        return "".join(sorted({c[0] for c in self.controls}))

    @property
    def patterns(self) -> list[tuple[str, str]]:
        """First character and all rests that follow it, as regular expressions."""
        return [(re.escape(x), "|".join(re.escape(c[1:]) for c in sorted(self.controls, key=len, reverse=True) if c[0] == x)) for x in self.leads]

    def escape(self, x: Column) -> Column:
        for lead, rests in self.patterns:
            x = F.regexp_replace(x, rf"({lead}\\*+)({rests})", r"$1\\$2")
        return x

    def unescape(self, x: Column) -> Column:
        for lead, rests in self.patterns:
            x = F.regexp_replace(x, rf"({lead}\\*)\\({rests})", "$1$2")
        return x

    def tokens(self, p: Column) -> Column:
        """Tokens that an attachment's placeholder stands for."""
        tiles = lambda n: F.ceil(F.greatest(F.coalesce(p[n], F.lit(0)), F.lit(1)) / self.tile).cast("long")
        seconds = F.when(p["seconds"].between(0, 1e12), p["seconds"]).otherwise(0.0)
        return (
            F.when(p["kind"] == "image", F.least(tiles("width") * tiles("height"), F.lit(self.most_tiles)))
            .when(p["kind"] == "audio", F.greatest(F.ceil(seconds * self.per_second), F.lit(1)))
            .when(p["kind"] == "document", F.greatest(F.coalesce(p["pages"], F.lit(1)), F.lit(1)).cast("long") * self.per_page)
            .otherwise(1)
            .cast("long")
        )

    def placeholder(self, kind: Column) -> Column:
        out = F.lit(self.other)
        for k, mark in self.placeholders.items():
            out = F.when(kind == k, mark).otherwise(out)
        return out


def pieces(role: Column, parts: Column, t: Template) -> Column:
    """The visitor: an array of (kind, out, ref, tokens); the head, a piece for each part, the end."""

    def piece(kind, out, ref, tokens) -> Column:
        return F.struct(kind.alias("kind"), out.alias("out"), ref.alias("ref"), tokens.alias("tokens"))

    def visit(p: Column) -> Column:
        kind = F.coalesce(p["kind"], F.lit("text"))
        return F.when(kind == "text", piece(kind, t.escape(F.coalesce(p["text"], F.lit(""))), none, F.lit(0).cast("long"))).otherwise(piece(kind, t.placeholder(kind), p["ref"], t.tokens(p)))

    none, no_tokens = F.lit(None).cast("string"), F.lit(0).cast("long")
    head = piece(F.lit("head"), F.concat(F.lit(t.head), t.escape(role), F.lit(t.middle)), none, no_tokens)
    end = piece(F.lit("end"), F.lit(t.end), none, no_tokens)
    visited = F.transform(F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull()), visit)
    return F.concat(F.array(head), visited, F.array(end))


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, formatted, loss (spans), attachments, placeholder_tokens of each conversation; turns has conv_id, turn, role and parts.

    A span of loss has start and chars (code points) and start_byte and bytes (UTF-8) in formatted; an attachment its turn (from 0),
    kind, ref, start (of its placeholder, in code points) and tokens, in the order of the placeholders.
    """
    t = template or Template()
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.col("parts").cast(PARTS).alias("parts"))
    by_turn = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "parts")
    rows = rows.withColumn("at", F.row_number().over(by_turn) - 1)
    flat = rows.select("conv_id", "at", F.col("role").isin(*t.trained).alias("trained"), F.posexplode(pieces(F.col("role"), F.col("parts"), t)).alias("part", "p")).select("conv_id", "at", "trained", "part", "p.*")
    before = W.partitionBy("conv_id").orderBy("at", "part").rowsBetween(W.unboundedPreceding, -1)
    size = {"start": F.length("out"), "start_byte": F.octet_length("out")}
    flat = flat.withColumns({k: F.coalesce(F.sum(n.cast("long")).over(before), F.lit(0)) for k, n in size.items()})
    piece = F.struct("at", "part", "trained", "kind", "out", "ref", "tokens", "start", "start_byte")
    every = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.sum("tokens").alias("placeholder_tokens"))
    of = F.col("pieces")
    span = lambda p: F.struct(p["start"].alias("start"), F.length(p["out"]).alias("chars"), p["start_byte"].alias("start_byte"), F.octet_length(p["out"]).alias("bytes"))
    attached = lambda p: F.struct(p["at"].alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["start"].alias("start"), p["tokens"].alias("tokens"))
    return every.select(
        "conv_id",
        F.array_join(F.transform(of, lambda p: p["out"]), "").alias("formatted"),
        F.transform(F.filter(of, lambda p: p["trained"] & (p["kind"] == "text")), span).alias("loss"),
        F.transform(F.filter(of, lambda p: ~p["kind"].isin("head", "text", "end")), attached).alias("attachments"),
        "placeholder_tokens",
    )


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """The turns of a formatted conversation: an array of (role, text), attachments being placeholders in text."""
    t = template or Template()
    turns = F.split(formatted, re.escape(t.end))

    def turn(x: Column) -> Column:
        role, text = F.split_part(x, F.lit(t.middle), F.lit(1)), F.split_part(x, F.lit(t.middle), F.lit(2))
        return F.struct(t.unescape(F.substr(role, F.lit(len(t.head) + 1))).alias("role"), t.unescape(text).alias("text"))

    return F.transform(F.slice(turns, 1, F.size(turns) - 1), turn)


def read_loss(formatted: Column, loss: Column, template: Template | None = None) -> Column:
    """All text under the loss mask, unescaped; spans are cut from the bytes, so each costs its own length."""
    t = template or Template()
    cut = lambda raw: F.transform(loss, lambda s: t.unescape(F.decode(F.substr(raw, (s["start_byte"] + 1).cast("int"), s["bytes"]), "UTF-8")))
    return F.array_join(F.transform(F.array(formatted.cast("binary")), cut)[0], "")


#: Both texts of the conversation that the query adds.
CONTROL = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, read back from the formatted conversations."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.sql(f"SELECT -1L AS conv_id, turn, role, '{CONTROL}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"))
    missing = {k: F.lit(None) for k in ("ref", "width", "height", "seconds", "pages")}
    part = F.struct(F.lit("text").alias("kind"), F.coalesce("text", F.lit("")).alias("text"), *(v.alias(k) for k, v in missing.items()))
    out = format_conversations(rows.select("conv_id", "turn", "role", F.array(part).alias("parts")))
    out = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("trained"), "placeholder_tokens")
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "placeholder_tokens",
    )


def oracle(template: Template | None = None) -> str:
    """DuckDB SQL of the query: escaping adds one character for each control string, and each turn has three marks."""
    t = template or Template()
    added = lambda c: " + ".join(rf"len(regexp_extract_all({c}, '{lead}\\*(?:{rests})'))" for lead, rests in t.patterns)
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text) AS said,
 coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role IN ({", ".join(f"'{r}'" for r in t.trained)})), '') AS trained,
 sum({len(t.head + t.middle + t.end)} + length(role) + length(text) + {added("role")} + {added("text")})::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(trained) AS loss_chars, sha256(trained) AS loss_sha256, formatted_chars, 0::BIGINT AS placeholder_tokens FROM c"""
