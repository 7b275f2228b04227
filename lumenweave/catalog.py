"""Which corpora there are, what they are for, and how a subset of them is planned."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lumenweave.operators.joins import union_all
from lumenweave.schema import SPLITS

#: Corpus -> tasks it gives. Fixed values.
CORPORA = {
    "vqa_v2": ("vqa",), "gqa": ("vqa",), "text_vqa": ("vqa",), "text_caps": ("captioning",), "coco": ("captioning",), "docvqa": ("vqa",),
    "infographics_vqa": ("vqa",), "ocr_vqa": ("vqa",), "vizwiz_vqa": ("vqa",), "aok_vqa": ("multiple_choice_vqa",), "ai2d": ("multiple_choice_vqa",),
    "visual7w": ("multiple_choice_vqa", "grounded_multiple_choice_vqa"), "refcoco": ("visual_grounding",), "refcoco_plus": ("visual_grounding",),
    "refcocog": ("visual_grounding",), "visual_genome": ("dense_captioning", "visual_grounding", "vqa", "relationship_detection"),
    "grit": ("grounded_captioning",), "llava_pretrain": ("captioning",), "llava_instruct": ("chat",), "pope_adversarial": ("vqa",),
    "pope_popular": ("vqa",), "pope_random": ("vqa",), "vsr": ("image_text_match",), "nocaps": ("captioning",), "localized_narratives": ("captioning",),
}
#: The corpora of both stages. Fixed values.
PRETRAINING = frozenset({"llava_pretrain"})
INSTRUCTION_TUNING = frozenset(
    {"ai2d", "aok_vqa", "coco", "docvqa", "gqa", "grit", "infographics_vqa", "llava_instruct", "ocr_vqa", "refcoco", "refcoco_plus", "refcocog", "text_caps", "visual7w", "visual_genome", "vqa_v2", "vsr"}
)
if not PRETRAINING | INSTRUCTION_TUNING <= CORPORA.keys():
    raise ValueError("a subset names a corpus that the catalog lacks")
_TUNING_SPLITS = ("train", "validation")


@dataclass(frozen=True)
class Settings:
    """Sizes of packed records."""

    annotations_per_image: int = 20
    regions_per_chunk: int = 10
    questions_per_turn: int = 3
    segment_window: float = 0.4
    rows_per_file: int = 10_000


def plan(subset: str, split: str) -> list[tuple[str, str]]:
    """``(corpus, task)`` pairs of a subset: a corpus by name, all corpora of a task, ``pretrain`` or ``instruction_tuning``.

    Instruction tuning has only a training and a validation split. Unknown names and splits raise.
    """
    if split not in SPLITS:
        raise ValueError(f"no split {split}")
    if subset in CORPORA:
        return [(subset, t) for t in CORPORA[subset]]
    if subset == "pretrain":
        return [(c, t) for c in sorted(PRETRAINING) for t in CORPORA[c]]
    if subset == "instruction_tuning":
        return [(c, t) for c in sorted(INSTRUCTION_TUNING) for t in CORPORA[c]] if split in _TUNING_SPLITS else []
    by_task = [(c, t) for c, ts in CORPORA.items() for t in ts if t == subset]
    if not by_task:
        raise ValueError(f"no corpus, task or subset {subset}")
    return by_task


Loader = Callable[[str, str], DataFrame]


def subset(loaders: dict[str, Loader], name: str, split: str) -> DataFrame:
    """The records of a subset: the union of its corpora's loaders, each called with (task, split)."""
    pairs = plan(name, split)
    lacking = sorted({c for c, _ in pairs} - loaders.keys())
    if lacking:
        raise ValueError(f"no loader for {lacking}")
    if not pairs:
        raise ValueError(f"{name} has no split {split}")
    return union_all([loaders[c](t, split) for c, t in pairs])


def catalog_table(spark: SparkSession) -> DataFrame:
    """``corpus, task, in_pretraining, in_instruction_tuning``."""
    rows = [(c, t, c in PRETRAINING, c in INSTRUCTION_TUNING) for c, ts in CORPORA.items() for t in ts]
    return spark.createDataFrame(rows, "corpus string, task string, in_pretraining boolean, in_instruction_tuning boolean")
