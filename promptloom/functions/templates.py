"""Prompt templates.

Supported template language: ``{{column}}`` placeholders (spaces inside the braces
allowed; any scalar column), ``{{answer_choices[column]}}``, ``|||`` between input and
target, and answer choices as a ``|||``-separated template.  A template is cut into
literals and placeholders first and filled once, so a field that holds ``|||`` or
``{{...}}`` is plain text; an unknown placeholder fails.  General Jinja is out of scope
(a per-row library); see the README.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import bounded_broadcast
from .text import NO_LABEL, strip_ws

# fixed values: the input/target separator and the knowledge block marker
SEP = r"\|\|\|"
KIC = "[KiC]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


PLACEHOLDER = r"\{\{\s*(.*?)\s*\}\}"
CHOICE = r"^answer_choices\[\s*(\w+)\s*\]$"


def render(template, fields, choices=None) -> Column:
    """Fill each ``{{field}}`` of ``template`` once from the column of that name (null -> '').

    ``choices``: the answer choices that ``{{answer_choices[field]}}`` picks from."""
    t = _c(template)
    values = F.create_map(*[x for f in fields for x in (F.lit(f), F.coalesce(F.col(f).cast("string"), F.lit("")))]) \
        if fields else F.create_map().cast("map<string,string>")

    def value(name):
        found = values[name]
        if choices is not None:
            label = values[F.regexp_extract(name, CHOICE, 1)]
            found = F.coalesce(found, F.get(choices, label.try_cast("int")))
        return F.coalesce(found, F.raise_error(F.concat(F.lit("a template has an unknown placeholder: "), name)))

    literals = F.split(t, PLACEHOLDER, -1)
    filled = F.transform(F.regexp_extract_all(t, F.lit(PLACEHOLDER), F.lit(1)), value)
    return F.array_join(F.zip_with(literals, F.concat(filled, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def remove_hyphens(df: DataFrame) -> DataFrame:
    """Column names with '-' become '_' before templating."""
    return df.withColumnsRenamed({c: c.replace("-", "_") for c in df.columns if "-" in c})


def apply_template_cols(template, fields, choices_template=None):
    """F2/F20 as columns: (inputs, targets, answer_choices).

    Two parts -> stripped input and target ('' target -> '<NO LABEL>');
    any other number of parts -> both empty (dropped later by P9)."""
    choices = None
    if choices_template is not None:
        ch = _c(choices_template)
        choices = F.when(ch.isNotNull(), F.transform(F.split(ch, SEP), lambda c: strip_ws(render(c, fields))))
    parts = F.split(_c(template), SEP, -1)
    ok = F.size(parts) == 2
    inputs = F.when(ok, strip_ws(render(F.get(parts, 0), fields, choices))).otherwise(F.lit(""))
    target = strip_ws(render(F.get(parts, 1), fields, choices))
    targets = F.when(ok, F.when(target == "", F.lit(NO_LABEL)).otherwise(target)).otherwise(F.lit(""))
    return inputs, targets, choices


SCALARS = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp")


def apply_templates(df: DataFrame, templates: DataFrame, *, on=("dataset_name",), fields=None,
                    keep=()) -> DataFrame:
    """J10 + F2 + P9: every row under every template of its dataset.

    ``templates``: ``on`` keys + template_name, template_str [, answer_choices].
    A null-safe equi-join on the keys (a null config is a key of its own): the template
    table is broadcast when its rows and bytes are proven small, otherwise both sides
    shuffle and AQE splits a hot dataset.  ``fields``: the columns placeholders may
    name; all scalar columns by default.
    """
    df = remove_hyphens(df)
    fields = list(fields or [c for c, t in df.dtypes if t in SCALARS or t.startswith("decimal")])
    has_choices = "answer_choices" in templates.columns
    right = templates.select(*[F.col(c).alias(f"_on_{c}") for c in on], F.col("template_name").alias("_tpl_name"),
                             F.col("template_str").alias("_tpl_str"),
                             *([F.col("answer_choices").alias("_tpl_choices")] if has_choices else []))
    cond = F.lit(True)
    for c in on:
        cond = cond & df[c].eqNullSafe(right[f"_on_{c}"])
    j = df.drop("template_name").join(bounded_broadcast(right), cond)
    fields = [f for f in fields if f != "template_name"]
    inputs, targets, choices = apply_template_cols("_tpl_str", fields, "_tpl_choices" if has_choices else None)
    cols = [*keep, *on, F.col("_tpl_name").alias("template_name"), inputs.alias("inputs_pretokenized"),
            targets.alias("targets_pretokenized")]
    if choices is not None:
        cols.append(choices.alias("answer_choices"))
    out = j.select(*cols)
    return out.where((F.length("inputs_pretokenized") > 0) & (F.length("targets_pretokenized") > 0))


# ------------------------------------------------------------------ F19
_LEXICON = "struct<gloss:map<string,array<struct<glosses:array<string>>>>>"
_CAUSAL = "map<string,array<struct<sent:string>>>"
_OTHER = "map<string,array<struct<sentence_key:string>>>"


def knowledge_texts(knowledge_json, types) -> Column:
    """the knowledge lines of the chosen types, in the JSON's key order.

    * ``lexicon``: per gloss key with entries, the first entry's first five
      glosses joined by newlines;
    * ``causal``: per key, ``sent`` of items 0..4;
    * any other type: per key with entries, the first sentence of the JSON
      list held in ``sentence_key`` of item 0.
    """
    chosen = F.array(*[F.lit(t) for t in types]) if types else F.array().cast("array<string>")
    entries = F.filter(F.map_entries(F.from_json(_c(knowledge_json), "map<string,string>")),
                       lambda e: F.array_contains(chosen, e["key"]))

    def lines(e):
        lex = F.map_values(F.from_json(e["value"], _LEXICON)["gloss"])
        lex_lines = F.transform(F.filter(lex, lambda a: F.size(a) > 0),
                                lambda a: F.array_join(F.slice(F.get(a, 0)["glosses"], 1, 5), "\n"))
        causal = F.map_values(F.from_json(e["value"], _CAUSAL))
        causal_lines = F.flatten(F.transform(causal, lambda a: F.transform(F.slice(a, 1, 5), lambda x: x["sent"])))
        other = F.map_values(F.from_json(e["value"], _OTHER))
        other_lines = F.transform(
            F.filter(other, lambda a: F.size(a) > 0),
            lambda a: F.array_join(F.slice(F.from_json(F.get(a, 0)["sentence_key"], "array<string>"), 1, 1),
                                   "\n"))
        return (F.when(e["key"] == "lexicon", lex_lines)
                .when(e["key"] == "causal", causal_lines).otherwise(other_lines))

    return F.flatten(F.transform(entries, lines))


def append_knowledge(inputs, knowledge_json, types) -> Column:
    """``input + "\\n[KiC]\\n" + "\\n".join(lines) + "\\n[KiC]\\n"``."""
    return F.concat(_c(inputs), F.lit("\n" + KIC + "\n"),
                    F.array_join(knowledge_texts(knowledge_json, types), "\n"),
                    F.lit("\n" + KIC + "\n"))
