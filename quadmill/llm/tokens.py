"""Token counts: pieces are counted once per distinct pre-token and joined to the documents' pre-token frequencies."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Pre-tokens whose counts go to every worker: the most frequent ones, so many at most (some 100 bytes each). The rest are
#: joined by shuffle.
HEAD = 500_000
#: Different pre-tokens that a worker counts before it hands them on.
HOLD = 200_000
MARK = "▁"  # stands for a space
_MARKED = re.compile(f"{MARK}+[^{MARK}]*")


def check_model(path: str) -> None:
    """Pieces must not cross from other characters to a space, else counts of pre-tokens would not add up."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm = model.normalizer_spec
    plain = norm.add_dummy_prefix and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap and not model.trainer_spec.treat_whitespace_as_suffix
    crossing = [p.piece for p in model.pieces if p.type in (1, 4) and MARK in p.piece.lstrip(MARK)]
    if not plain or crossing or any(p.type == 4 for p in model.pieces):
        raise ValueError(f"{path}: pieces can cross pre-tokens, e.g. {crossing[:3]}")


def pre_tokens(text: str | None) -> list[str]:
    """The pre-tokens of a text, each a run of spaces and what follows it, without its first space. The library puts one
    space before every text. Joined with a space they are the text; no piece crosses them."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return [x[1:] for x in _MARKED.findall(MARK + text.replace(" ", MARK))]
    return text.split(" ")


def count_pre_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: (piece, freq) of a partition's texts, in parts of about HOLD."""
    seen: Counter[str] = Counter()
    for b in batches:
        for text in b["text"]:
            seen.update(pre_tokens(text))
            if len(seen) > HOLD:
                yield pd.DataFrame({"piece": list(seen), "freq": list(seen.values())})
                seen.clear()
    if seen:
        yield pd.DataFrame({"piece": list(seen), "freq": list(seen.values())})


def per_document(head: Broadcast[dict[str, int]]):
    """For mapInPandas: of each text the frequencies of its pre-tokens; those in head are multiplied with their counts and
    summed as n, the others stay as pieces and freqs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = head.value
        for batch in batches:
            for at in range(0, len(batch), 1000):
                b = batch.iloc[at : at + 1000]
                sums, pieces, freqs = [], [], []
                for text in b["text"]:
                    counted = Counter(pre_tokens(text))
                    n, rest = 0, {}
                    for piece, freq in counted.items():
                        k = known.get(piece)
                        if k is None:
                            rest[piece] = freq
                        else:
                            n += k * freq
                    sums.append(n)
                    pieces.append(list(rest))
                    freqs.append(list(rest.values()))
                yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n": sums, "pieces": pieces, "freqs": freqs})

    return run


def piece_counter(name: str):
    """For mapInPandas: adds n_tokens to batches of (piece, freq). The model file is found on the worker, by name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=public_tokenizers.path(name))
        for b in batches:
            counts = [len(x) if s else 1 for s, x in zip(b["piece"], model.encode(list(b["piece"]), num_threads=1))]
            yield b.assign(n_tokens=pd.Series(counts, index=b.index, dtype="int64"))

    return run


def head_frequency(vocabulary: DataFrame, head: int) -> int:
    """The least frequency, up to a twelfth, that at most `head` pre-tokens reach. The frequencies meet in some hundred
    classes, so neither a sort nor a single task sees the pre-tokens."""
    classes = vocabulary.groupBy(F.floor(F.log2("freq") * 8).alias("class")).agg(F.count("*").alias("n"), F.min("freq").alias("least"))
    n, least = 0, 1 << 62
    for row in sorted(classes.collect(), key=lambda r: -r["class"]):
        n += row["n"]
        if n > head:
            break
        least = row["least"]
    return least


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096, head: int = HEAD) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, as the library would count.

    Null text counts as empty: no bytes, no tokens. Rows with the same doc_id are rows of their own, alike or not; an empty
    table gives no rows. Other columns of docs are not read, whatever their names.

    Two passes over the texts: distinct pre-tokens with their frequency (combined before the shuffle) get their piece
    counts once; then each document's pre-token frequencies meet them. The most frequent ones go to every worker and cover
    most words; what is left of a document is written down and joined by shuffle, each piece rare by then, so no key
    is hot. Ids are made for distinct pre-tokens alone, to be counted, and go no further.
    """
    import public_tokenizers

    check_model(public_tokenizers.path(model))
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    vocabulary = docs.select("text").where("text <> ''").mapInPandas(count_pre_tokens, "piece string, freq long").groupBy("piece").agg(F.sum("freq").alias("freq"))
    vocabulary = scratch.save(vocabulary.mapInPandas(piece_counter(model), "piece string, freq long, n_tokens long"))
    least = head_frequency(vocabulary, head)
    known = vocabulary.where(F.col("freq") >= least).select("piece", "n_tokens").toArrow()  # `head` rows at most
    known = spark.sparkContext.broadcast(dict(zip(known["piece"].to_pylist(), known["n_tokens"].to_pylist())))

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n long, pieces array<string>, freqs array<int>"
    rows = scratch.save(rows.mapInPandas(per_document(known), schema).withColumn("row", F.monotonically_increasing_id()))
    left = rows.select("row", "freqs", F.posexplode("pieces").alias("pos", "piece")).select("row", "piece", F.get("freqs", F.col("pos")).alias("freq"))
    rare = vocabulary.where(F.col("freq") < least).select("piece", "n_tokens")
    more = left.join(rare, "piece").groupBy("row").agg(F.sum(F.col("freq") * F.col("n_tokens")).alias("more"))
    out = rows.select("row", "doc_id", "n_bytes", "n").join(more, "row", "left")
    out = out.select("doc_id", "n_bytes", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
