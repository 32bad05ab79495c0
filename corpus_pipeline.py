"""A corpus pipeline: toxicity, quality, near-duplicates, benchmark passages, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; all
but the last return the columns of ``docs``. Models are fitted on the stage's
own input and the labels in ``sf_dir``.
"""

from lunario.llm.bpe import token_documents
from lunario.llm.decontamination import clean_documents
from lunario.llm.quality import good_documents
from lunario.llm.simhash import kept_documents
from lunario.llm.toxicity import civil_documents
from lunario.session import written

STAGES = [
    ("levenshtein_toxicity", civil_documents),
    ("importance_resampling", good_documents),
    ("simhash_near_dedup", kept_documents),
    ("benchmark_decontamination", clean_documents),
    ("transducer_bpe", token_documents),
]

# SQL cannot express the classifiers, the trie walk and the tokenizer; tests/llm compares with plain versions
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
