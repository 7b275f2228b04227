"""The common record, its tasks and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
_BOX = T.ArrayType(T.FloatType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


QA = _struct(question=_S, answer=_S)
REGION = _struct(bbox=_BOX, phrase=_S)
RELATION = _struct(subject_name=_S, subject_bbox=_BOX, object_name=_S, object_bbox=_BOX, predicate=_S)
TURN = _struct(role=_S, text=_S)
#: One annotated record, whatever its source.
RECORD = _struct(
    task=_S, image=_struct(path=_S, bytes=T.BinaryType()), caption=_S, qa_pairs=T.ArrayType(QA), region=T.ArrayType(REGION),
    relation=T.ArrayType(RELATION), chat=T.ArrayType(TURN), source=_S, metadata=_S,
)

#: Tasks in the order of their numbers. Fixed values.
TASKS = (
    "vqa", "multiple_choice_vqa", "grounded_multiple_choice_vqa", "captioning", "grounded_captioning", "controlled_captioning", "dense_captioning",
    "visual_grounding", "relationship_detection", "object_detection", "image_text_match", "chat", "synthetic_vg",
)
SPLITS = ("train", "validation", "test", "teststd", "testdev")
#: Spellings of splits in the corpora.
SPLIT_NAMES = {"train": "train", "restval": "train", "val": "validation", "validation": "validation", "test": "test", "teststd": "teststd", "testdev": "testdev"}


def to_record(df: DataFrame, **columns: Column) -> DataFrame:
    """The nine columns of the record; those not given are null, all have the declared type."""
    unknown = set(columns) - set(RECORD.names)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    # In two steps: a new column may be made from an old one whose name another new column takes.
    made = df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f"_new_{f.name}") for f in RECORD.fields])
    return made.toDF(*RECORD.names)


def pack_metadata(**values: Column) -> Column:
    """The values as JSON text, nulls included."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]), {"ignoreNullFields": "false"})


def normal_split(split: Column) -> Column:
    """The split under its usual name; null for unknown ones."""
    mapping = F.create_map(*[F.lit(x) for pair in SPLIT_NAMES.items() for x in pair])
    return F.try_element_at(mapping, F.lower(F.trim(split)))


def task_number(task: Column) -> Column:
    """The task's number from 0; -1, the padding value, for an unknown one."""
    return F.array_position(F.array(*[F.lit(t) for t in TASKS]), task).cast("int") - 1


def payload(task: Column, caption: Column, region: Column, qa_pairs: Column, chat: Column) -> Column:
    """The columns that the task uses, as JSON; null for a task without payload."""
    take = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()]), {"ignoreNullFields": "false"})
    return (
        F.when(task.isin("vqa", "multiple_choice_vqa"), take(qa_pairs=qa_pairs))
        .when(task.isin("captioning", "image_text_match"), take(caption=caption))
        .when(task.isin("dense_captioning", "visual_grounding"), take(region=region))
        .when(task == "chat", take(chat=chat))
        .when(task == "grounded_multiple_choice_vqa", take(qa_pairs=qa_pairs, region=region))
        .when(task == "grounded_captioning", take(caption=caption, region=region))
    )
