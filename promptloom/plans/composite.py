"""User-level composite plans (D2-D8, M6, J14 batch form, R1).

Each function declares one Spark plan from DataFrame operators; the only
actions are the size checks inside ``knn_join`` / ``bm25_join`` and the
explicit writes.  Index "files" are Parquet tables partitioned by shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.templates import append_knowledge, apply_templates
from ..operators.augment import augment, rank_demonstrations
from ..operators.chosen import chosen_corpus
from ..operators.embed import embed_text
from ..operators.filters import (allowed_templates, attach_template, check_targets, drop_omitted, keep_original, train_or_all,
                                 with_lineage)
from ..operators.knn import knn_join
from ..operators.mixture import sample_n
from ..session import bounded_broadcast, cut_lineage
from ..functions.names import parse_task_path
from ..sources.commit import require_committed, write_committed
from ..sources.discovery import folder_paths, list_folders, read_folders
from ..sources.io import load_shard, save_shard, write_once

TEMPLATE_MODES = ("none", "own", "nearest")


def build_index(prompted: DataFrame, *, key_col: str = "inputs_pretokenized", order_col: str = "row_id",
                dim: int = 64, embedder=None, add_lineage: bool = False, columns=None,
                materialize: bool = False) -> DataFrame:
    """D3: (lineage) + one vector per row of the key column; the corpus table.

    ``prompted`` is the union of the prompted datasets (``unionByName``, no
    distinct, U1).  Write it with ``save_index`` / ``save_shard``, or pass
    ``materialize=True`` to get it back as a reliable checkpoint: the vectors
    are computed once however many searches read them."""
    df = with_lineage(prompted, order_col) if add_lineage else prompted
    out = embed_text(df, key_col, dim=dim, embedder=embedder)
    if columns is not None:
        out = out.select(*columns, "embedding")
    return cut_lineage(out) if materialize else out


def save_index(index: DataFrame, root: str, shard: str, *, key_name: str = "inputs_pretokenized",
               dataset_paths=None) -> str:
    """S13 for an index built by ``build_index``."""
    return save_shard(index, root, shard, key_name=key_name, dataset_paths=dataset_paths)


def index_folders(spark, root: str, tasks, out_root: str, shard: str, *, schema: str, order_col: str,
                  key_col: str = "inputs_pretokenized", metadata: DataFrame | None = None, aliases: dict | None = None,
                  depth: int = 2, first: int | None = None, dim: int = 64, embedder=None) -> DataFrame:
    """D3 in one call: stored dataset folders to a stored, named shard, which is read back.

    Folders are found by task prefix (S7) and, with ``metadata``, cut to the originals it lists
    (P5); every folder's schema is checked before anything runs; all are read in one scan
    (U1), their train rows or else all (S14); rows carry dataset, template and position (P1, P2);
    ``key_col`` is embedded (V1) and the shard committed with the list of its sources (S13)."""
    found = list_folders(spark, root, tasks, depth=depth, first=first)
    if metadata is not None:
        found = keep_original(found, metadata, aliases=aliases)
    paths = folder_paths(found)
    rows = train_or_all(read_folders(spark, paths, schema), "path")
    name = parse_task_path(F.regexp_replace("path", "(^|/)[^/=]+=", "$1"))
    rows = rows.withColumns({"dataset_name": name["task"], "template_name": name["template"]}).drop("path")
    index = build_index(rows, key_col=key_col, order_col=order_col, dim=dim, embedder=embedder, add_lineage=True)
    save_shard(index, out_root, shard, key_name=key_col, dataset_paths=paths)
    return load_shard(spark, out_root, shard)[0]


def chosen_index(augmented: DataFrame, *, order_cols=("row_id",), dim: int = 64, embedder=None) -> DataFrame:
    """The distinct chosen examples become a new, smaller corpus with vectors.

    Stored: a search reads a corpus several times, and this one is a whole augmentation."""
    cc = chosen_corpus(augmented, order_cols=order_cols)
    return cut_lineage(embed_text(cc, "inputs_pretokenized", dim=dim, embedder=embedder))


def template_index(templates: DataFrame, *, dim: int = 64, embedder=None) -> DataFrame:
    """Vectors of template strings (``template_str``)."""
    return embed_text(templates, "template_str", dim=dim, embedder=embedder)


def retrieve(queries: DataFrame, corpus: DataFrame, k: int, *, query_key: str = "row_id",
             corpus_key: str = "row_id", text_col: str = "inputs_pretokenized", shard_col: str | None = "shard",
             dim: int = 64, embedder=None, exclude_self: bool = False) -> DataFrame:
    """J14 / D6 retrieval: embed the query text, k nearest corpus rows per shard."""
    q = queries if "embedding" in queries.columns else embed_text(queries, text_col, dim=dim, embedder=embedder)
    return knn_join(q, corpus, k, query_key=query_key, corpus_key=corpus_key,
                    shard_col=shard_col if shard_col in corpus.columns else None, exclude_self=exclude_self)


def nest_candidates(candidates: DataFrame, corpus: DataFrame, *, corpus_key: str = "row_id",
                    fields=("inputs_pretokenized", "targets_pretokenized", "dataset_name",
                            "template_name", "idx")) -> DataFrame:
    """Per query, ``scores`` (shard order) and ``retrieved_examples`` as
    an array of structs; a view gives the struct-of-arrays form."""
    c = candidates.join(corpus.select(F.col(corpus_key).alias("corpus_id"), *fields), "corpus_id")
    nested = c.groupBy("query_id").agg(F.array_sort(F.collect_list(
        F.struct("shard_ord", "rank", "score", *fields))).alias("_c"))
    return nested.select("query_id", F.transform("_c", lambda x: x["score"]).alias("scores"),
                         F.transform("_c", lambda x: F.struct(*[x[f].alias(f) for f in fields]))
                         .alias("retrieved_examples"))


def retrieve_task(rows: DataFrame, templates: DataFrame, allow: DataFrame, corpus: DataFrame, k: int, *,
                  out_path: str | None = None, splits=None, dim: int = 64, embedder=None) -> DataFrame:
    """A named dataset under every allowed template, retrieved in one plan.

    ``rows``: raw rows with ``dataset``, ``config``, ``split`` and fields;
    ``templates``: ``dataset, config, template_name, template_str``;
    ``allow``: the allow list ``dataset, config, template``.  With
    ``out_path`` the result is written once (S12), partitioned by template, and the
    stored rows are returned."""
    if out_path:
        spark = rows.sparkSession
        write_once(lambda: retrieve_task(rows, templates, allow, corpus, k, splits=splits, dim=dim, embedder=embedder),
                   spark, out_path, partition_by=("template_name",))
        return spark.read.parquet(out_path)
    if splits:
        rows = rows.where(F.col("split").isin(*splits))
    tpl = allowed_templates(templates.withColumnRenamed("template_name", "template"), allow,
                            ("dataset", "config", "template")).withColumnRenamed("template", "template_name")
    applied = apply_templates(rows, tpl, on=("dataset", "config"),
                              keep=[c for c in ("row_id", "split", "idx") if c in rows.columns])
    # one number per prompt, stored: unlike a hash of the keys it cannot meet another prompt's
    applied = cut_lineage(applied.withColumn("qid", F.monotonically_increasing_id()))
    cand = retrieve(applied, corpus, k, query_key="qid", dim=dim, embedder=embedder)
    return applied.join(nest_candidates(cand, corpus).withColumnRenamed("query_id", "qid"), "qid", "left").drop("qid")


def chosen_keys(queries: DataFrame, candidates: DataFrame, corpus: DataFrame, K: int, **rules) -> DataFrame:
    """The distinct (dataset_name, template_name, idx) an augmentation with K
    demonstrations would choose -- from the key-only ranking, no text built."""
    picked = rank_demonstrations(queries, candidates, corpus, K, **rules)
    return picked.select(F.col("c_dataset").alias("dataset_name"), F.col("c_template").alias("template_name"),
                         F.col("c_idx").alias("idx")).distinct()


def seen_in_training(queries: DataFrame, chosen: DataFrame, corpus: DataFrame, vectors: DataFrame, K: int, *,
                     k: int = 20, max_length: int = 1024, key: str = "row_id") -> DataFrame:
    """Augment with demonstrations drawn only from the examples chosen
    during training (A8's corpus) -- same rules as D1; K = 0 gives [].

    ``chosen``: the training augmentation's chosen examples -- either its
    output (``chosen_examples`` column) or their keys (``chosen_keys``).
    ``vectors``: key and ``embedding`` (and ``shard``) of queries and corpus."""
    if "chosen_examples" in chosen.columns:
        chosen = chosen_corpus(chosen)
    chosen = chosen.select("dataset_name", "template_name", "idx")
    corpus = corpus.join(chosen, ["dataset_name", "template_name", "idx"], "left_semi")
    cand = knn_join(vectors, vectors.join(corpus.select(key), key, "left_semi"), k, query_key=key, corpus_key=key,
                    shard_col="shard" if "shard" in vectors.columns else None)
    return augment(queries, cand, corpus, K, max_length=max_length)


def _numbered(templates: DataFrame, out: str) -> DataFrame:
    """The templates with a number in (task, template_name) order."""
    w = Window.orderBy("task", "template_name")     # a dimension table: one task
    return templates.withColumn(out, F.row_number().over(w).cast("bigint"))


def template_augmented_set(rows: DataFrame, templates: DataFrame, *, mode: str = "own",
                           train_templates: DataFrame | None = None, max_length: int = 1024,
                           dim: int = 64, embedder=None) -> DataFrame:
    """Prefix ``template_str + '\\n\\n'`` to the input.

    ``rows`` carry ``task, template_name, inputs_pretokenized``;
    ``templates`` (J8 lookup) carry ``task, template_name, template_str``.
    ``mode``: ``none`` (input unchanged, no chosen template), ``own`` (the
    row's template) or ``nearest`` (the training template nearest to the
    row's template string, J5, k = 1 over ``train_templates``)."""
    if mode not in TEMPLATE_MODES:
        raise ValueError(f"mode must be one of {TEMPLATE_MODES}")
    chosen_t = "struct<task_full_name:string,template_name:string,template_str:string>"
    if mode == "none":
        out = rows.withColumn("chosen_examples", F.lit(None).cast(chosen_t))
    else:
        j = attach_template(rows, templates.select("task", "template_name", "template_str"),
                            ("task", "template_name"), fail=True)
        if mode == "own":
            pick = F.struct(F.col("task").alias("task_full_name"), F.col("template_name"),
                            F.col("template_str"))
            out = j.withColumn("chosen_examples", pick)
        else:
            # stored: the numbers must not change between uses
            tt = cut_lineage(template_index(_numbered(train_templates, "tid"), dim=dim, embedder=embedder))
            et = cut_lineage(template_index(_numbered(templates, "eid"), dim=dim, embedder=embedder))
            near = knn_join(et, tt, 1, query_key="eid", corpus_key="tid")
            nt = near.join(tt.select(F.col("tid").alias("corpus_id"), F.col("task").alias("n_task"),
                                     F.col("template_name").alias("n_template"),
                                     F.col("template_str").alias("n_str")), "corpus_id")
            m = et.select("eid", "task", "template_name").join(
                nt.withColumnRenamed("query_id", "eid"), "eid").drop("eid", "corpus_id")
            mm = m.select("task", "template_name", "n_task", "n_template", "n_str")
            j = j.join(bounded_broadcast(mm), ["task", "template_name"])     # a row per evaluation template
            out = j.withColumn("template_str", F.col("n_str")).withColumn(
                "chosen_examples", F.struct(F.col("n_task").alias("task_full_name"),
                                            F.col("n_template").alias("template_name"),
                                            F.col("n_str").alias("template_str")))
        out = out.withColumn("inputs_pretokenized",
                             F.concat(F.col("template_str"), F.lit("\n\n"), F.col("inputs_pretokenized")))
    return out.withColumn("inputs", T.truncate_left(T.tokenize("inputs_pretokenized"), max_length))


OUTPUT_SUFFIX = {"none": "no_demo", "own": "template_augmented_use_original", "nearest": "template_augmented_use_retrieved"}


def template_augmented_folders(spark, root: str, out_root: str, templates: DataFrame, *, schema: str, metadata: DataFrame,
                               tasks=None, mode: str = "own", train_templates: DataFrame | None = None,
                               max_length: int = 1024, depth: int = 2, dim: int = 64,
                               embedder=None) -> tuple[DataFrame, DataFrame]:
    """D8 from stored folders to a stored set: (its rows, the log of the run that wrote them), both read back.

    The folders of ``tasks`` (None: all) below ``root`` are found, those whose name contains one of their
    task's ``omit_templates`` are left out (P6), task and template are parsed from the path (P2), and the
    rows, read in one scan, get their template (J8 or J5, F6) and tokens (F7).  They are written as
    ``out_root/rows/output_name=../basename=../split=..``; the log has a row with the folders found and left out,
    the rows, and those that reach ``max_length`` (A6, counted while they are written).

    ``metadata`` is (task, omit_templates): a task it lacks fails, as does a template that ``templates`` lacks.
    A set that is whole is not written again.  Without a folder the set has no rows and the log zeros."""
    found = list_folders(spark, root, tasks, depth=depth, exact=tasks is not None).select("path", "basename")
    plain = F.regexp_replace("path", "(^|/)[^/=]+=", "$1")
    found = found.withColumn("_k", parse_task_path(plain)).withColumn("_dir", F.element_at(F.split(plain, "/"), -2))
    suffix = F.lit(f"__{root.rstrip('/').rsplit('/', 1)[-1]}__{OUTPUT_SUFFIX[mode]}")
    found = found.select("path", "basename", F.col("_k.task").alias("task"), F.col("_k.template").alias("template_name"),
                         F.concat(F.array_join(F.slice(F.split("_dir", "__"), 1, 2), "__"), suffix).alias("output_name"))
    known = metadata.select("task", "omit_templates").withColumn("_known", F.lit(True))
    found = found.join(bounded_broadcast(known), "task", "left").where(
        F.col("_known").isNotNull() | F.raise_error(F.concat(F.lit("unseen task: "), "task")).cast("boolean"))
    found = found.drop("_known", "omit_templates").distinct()

    def fill(folder: str) -> None:
        folders = cut_lineage(found)
        kept = cut_lineage(drop_omitted(folders, metadata))
        rows = read_folders(spark, folder_paths(kept), schema).join(bounded_broadcast(kept), "path").drop("path")
        out = template_augmented_set(rows, templates, mode=mode, train_templates=train_templates,
                                     max_length=max_length, dim=dim, embedder=embedder)
        seen = Observation("template set")
        out = out.observe(seen, F.count(F.lit(1)).alias("n_rows"),
                          F.count_if(F.size("inputs") == max_length).alias("n_exceed_max_length"))
        out.write.partitionBy("output_name", "basename", "split").parquet(f"{folder}/rows")
        n, left = folders.count(), kept.count()
        log = (n, n - left, seen.get.get("n_rows", 0), seen.get.get("n_exceed_max_length", 0))
        spark.createDataFrame([log], "n_folders bigint, n_omitted bigint, n_rows bigint, n_exceed_max_length bigint") \
            .write.parquet(f"{folder}/log")

    write_committed(spark, out_root, fill)
    where = require_committed(spark, out_root)
    return spark.read.schema(template_schema(schema)).parquet(f"{where}/rows"), spark.read.parquet(f"{where}/log")


def template_schema(schema: str) -> StructType:
    """The columns of a stored template-augmented set made of rows of ``schema``."""
    return StructType.fromDDL(
        schema + ", task string, template_name string, template_str string, chosen_examples struct<task_full_name: string, "
        "template_name: string, template_str: string>, inputs array<int>, output_name string, basename string, split string")


def knowledge_set(rows: DataFrame, templates: DataFrame, *, knowledge_col: str = "knowledge",
                  knowledge_types=("lexicon", "causal"), on=("dataset_name",), fields=None,
                  max_source_length: int = 1024, max_target_length: int = 256) -> DataFrame:
    """Template -> knowledge block -> target check -> tokens -> label masks."""
    keep = [c for c in rows.columns if c == knowledge_col or c == "row_id"]
    applied = apply_templates(rows, templates, on=on, fields=fields, keep=keep)
    applied = applied.withColumn("inputs_pretokenized", append_knowledge(
        "inputs_pretokenized", knowledge_col, list(knowledge_types)))
    if "answer_choices" in applied.columns:
        applied = check_targets(applied, mode="fail")
    return (applied
            .withColumn("inputs", T.truncate_right(T.tokenize("inputs_pretokenized"), max_source_length))
            .withColumn("targets", T.mask_labels(T.truncate_right(T.tokenize("targets_pretokenized"),
                                                                 max_target_length), append_eos_id=T.EOS_ID)))


def few_shot_set(rows: DataFrame, templates: DataFrame, n: int, *, key_col: str = "row_id", seed: int = 42,
                 on=("dataset_name",), fields=None, max_length: int = 1024) -> DataFrame:
    """M6: n seeded examples -> template -> tokens -> masked labels."""
    picked = sample_n(rows, n, key_col=key_col, seed=seed)
    applied = apply_templates(picked, templates, on=on, fields=fields, keep=(key_col,))
    return (applied.withColumn("input_ids", T.truncate_right(T.tokenize("inputs_pretokenized"), max_length))
            .withColumn("labels", T.mask_labels(T.append_eos(T.tokenize("targets_pretokenized")))))


def retrieval_log(rows: DataFrame, nested: DataFrame, *, key: str = "row_id",
                  template_col: str = "template_name") -> DataFrame:
    """One log record per prompt -- input, target, the retrieved
    inputs, targets, dataset names, idx and scores as text -- keyed by template.
    Write it partitioned by template (``partitionBy(template_col)``) instead of
    gathering a template's records into one value."""
    n = nested.withColumnRenamed("query_id", key)
    r = n.select(key,
                 F.transform("retrieved_examples", lambda x: x["inputs_pretokenized"]).alias("retrieved_input"),
                 F.transform("retrieved_examples", lambda x: x["targets_pretokenized"]).alias("retrieved_target"),
                 F.transform("retrieved_examples", lambda x: x["dataset_name"]).alias("retrieved_dataset_name"),
                 F.transform("retrieved_examples", lambda x: x["idx"]).alias("retrieved_idx"),
                 F.transform("scores", lambda s: s.cast("string")).alias("retrieval_scores"))
    return rows.select(key, template_col, F.col("inputs_pretokenized").alias("input"),
                       F.col("targets_pretokenized").alias("target")).join(r, key, "left")
