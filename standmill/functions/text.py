"""Prompts, status texts and scene names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages of answers, the request for an empty scene, and the metrics of a tree in their order.
LANGUAGE = {"en": "Write in English.", "zh": "Write in Simplified Chinese."}
NO_TREES = "There are no trees in this plot."
TREE_FIELDS = ("tree_id", "n_points", "height_m", "crown_width_m", "crown_ratio", "wood_points", "leaf_points", "leaf_wood_ratio", "mean_score", "center_x", "center_y", "base_z")


@dataclass(frozen=True)
class Instructions:
    """What a request says around the figures: the caller's words."""

    role: str = "Summarise the measurements below in plain words, without adding any."
    title: str = "Measurements (lengths in metres):"
    notes: dict[str, str] = field(default_factory=dict)  # of fields
    tasks: tuple[str, ...] = ()
    words: int | None = None  # of the answer, at most


def _request(fields: list[str], what: Instructions) -> Column:
    """Title, the fields as indented JSON (nulls stay), notes on fields, numbered tasks and the length of the answer."""
    data = F.to_json(F.struct(*fields), {"pretty": "true", "ignoreNullFields": "false"})
    parts = [[f"- {name}: {note}" for name, note in what.notes.items()], [f"{k}. {task}" for k, task in enumerate(what.tasks, 1)], [f"At most {what.words} words."] * bool(what.words)]
    return F.concat(F.lit(f"{what.title}\n"), data, F.lit("".join("\n\n" + "\n".join(p) for p in parts if p)))


def tree_prompts(trees: DataFrame, lang: str = "en", by: str = "scene_id", instructions: Instructions = Instructions()) -> DataFrame:
    """One request per tree: system has the role and the language, user the metrics and what is asked."""
    role = F.lit(f"{instructions.role} {LANGUAGE.get(lang, LANGUAGE['en'])}")
    return trees.select(by, "tree_id", role.alias("system"), _request(list(TREE_FIELDS), instructions).alias("user"))


def scene_prompts(scenes: DataFrame, summary: DataFrame, lang: str = "en", by: str = "scene_id", instructions: Instructions = Instructions()) -> DataFrame:
    """One request per scene; a scene without trees has no role and says so."""
    role = F.lit(f"{instructions.role} {LANGUAGE.get(lang, LANGUAGE['en'])}")
    made = summary.select(by, role.alias("system"), _request([c for c in summary.columns if c != by], instructions).alias("user"))
    return scenes.select(by).distinct().join(made, by, "left").withColumn("user", F.coalesce("user", F.lit(NO_TREES)))


STATUS_SCHEMA = "step string, progress double, completed_tiles int, error string, updated double"


def parse_status(text: Column, encoded: bool = False) -> Column:
    """A status text as a struct; all its fields are null for bad JSON. encoded: the text is base64."""
    plain = F.unbase64(text).cast("string") if encoded else text
    return F.from_json(plain, STATUS_SCHEMA, {"mode": "PERMISSIVE"})


def parse_listing(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines of id|path|size|result flag|meta JSON: size is null unless it is a number, and fields of the meta override."""
    parts = F.split(line, r"\|", 5)
    part = lambda k: F.try_element_at(parts, F.lit(k + 1))
    meta = F.from_json(part(4), "name string, size bigint")
    return lines.select(
        part(0).alias("id"), part(1).alias("path"), F.coalesce(meta["size"], F.expr(f"try_cast(try_element_at(split({line}, '[|]', 5), 3) AS bigint)")).alias("size"),
        (part(3) == "1").alias("has_result"), F.coalesce(meta["name"], F.substring_index(part(1), "/", -1)).alias("name"),
    ).filter(F.col("id").isNotNull() & (F.col("id") != ""))


def scene_attributes(name: Column) -> list[Column]:
    """site, plot and split of names like SITE_plot_7_annotated_test; null where a name does not tell."""
    known = lambda pattern: F.nullif(F.regexp_extract(name, pattern, 1), F.lit(""))
    return [F.substring_index(name, "_", 1).alias("site"), known(r"plot_?(\d+)").alias("plot"), known(r"_(train|val|test)$").alias("split")]
