from __future__ import annotations

from pyspark.sql import functions as F

from .byte_bpe import Vocabulary, decode, encode, load_ranks
from .common import read
from .registry import register

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Place of a public vocabulary file; the driver alone reads it."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op12_byte_bpe")
def op12(spark, sf_dir):
    """All documents encoded and decoded again by the public byte-level vocabulary."""
    vocabulary = Vocabulary(load_ranks(vocabulary_path()))
    tokens = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    digests = tokens.select("doc_id", "ids", "offsets", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                            F.sha2("ids", 256).alias("ids_sha256"))
    return decode(digests, vocabulary, ["doc_id", "n_tokens", "ids_sha256"]).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
