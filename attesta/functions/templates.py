"""Question templates by entity type and mode, as a small table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The default questions of each mode and entity type.
QUESTIONS = {
    "general": {
        "default": [
            "近期整體公開評價偏正面還是偏負面？",
            "有哪些官方說法、新聞與第三方資料可交叉參考？",
            "最近有哪些公開討論、聲明或待查事項？",
            "目前哪些部分已有公開資料，哪些仍待進一步查核？",
        ],
        "zoo": ["有哪些公開資料提到飼養環境、衛生、空間或照護品質？", "近期是否有與展演、互動或動物管理有關的新聞與評論？"],
        "shelter": ["近期是否有收容壓力、送養流程或安置問題的公開資料？", "有哪些資訊提到環境清潔、醫療照護或收容密度？"],
        "rescue_org": ["近期是否有救援流程、安置、送養或募款相關公開資料？", "有哪些第一手紀錄、官方說明或第三方資料可以交叉參考？"],
    },
    "animal_law": {
        "default": [
            "依目前公開資料，是否可能涉及動保法或主管機關稽查議題？",
            "有哪些內容明確提到動物福利、照護或飼養環境疑慮？",
            "目前可支持哪些動物福利疑慮，哪些仍待進一步查核？",
            "近期是否有裁罰、改善要求、官方說明或待查事項？",
        ],
        "zoo": ["近期是否有受傷、死亡、惡臭、疾病或照護不足的公開描述？", "是否有資訊提到圈養管理、繁殖、收容或展演爭議？"],
        "shelter": ["近期是否有超收、棄養、安置壓力或收容量相關疑慮？", "是否有公開資料提到稽查、裁罰、改善要求或主管機關回應？"],
        "rescue_org": ["近期是否有救援、安置、送養或繁殖管理相關疑慮？", "依目前公開資料，是否有與動保法、募款透明或稽查有關的待查事項？"],
    },
}


def question_templates(spark: SparkSession, types: list[str], questions: dict = QUESTIONS) -> DataFrame:
    """(entity_type, search_mode, pos, question): the default questions, then those of the type."""
    rows = [(t, mode, pos, q) for mode, by_type in questions.items() for t in types for pos, q in enumerate([*by_type.get("default", []), *by_type.get(t, [])])]
    return spark.createDataFrame(rows, "entity_type string, search_mode string, pos int, question string")


#: Templates up to which they are broadcast.
FEW_TEMPLATES = 10_000


def with_questions(entities: DataFrame, templates: DataFrame) -> DataFrame:
    """Each entity with the questions of its type. Templates are a few rows made by question_templates, which are counted before they are
    broadcast."""
    few = templates.limit(FEW_TEMPLATES + 1).count() <= FEW_TEMPLATES
    return entities.join(F.broadcast(templates) if few else templates.hint("merge"), "entity_type")
