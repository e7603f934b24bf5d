"""Token counts; huge texts are encoded in overlapping chunks that are spliced where they agree."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablewright.llm.common import map_rows, text_bytes
from tablewright.llm.tokens import Encoder, encoder

#: Code points of a chunk and of the first overlap tried.
CHUNK, OVERLAP = 32_768, 256

OUTPUT = T.StructType([
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("over_limit", T.BooleanType()),
])


def splice_points(text: str, ends: list[int], low: int, high: int) -> set[int]:
    """Token ends in [low, high) that hold for any chunking of the text.

    A pre-token never goes on over a blank, and it takes at most the one blank before it. So an
    end whose next character is a single blank between two other characters is an end in every
    scan of the text, wherever that scan began.
    """
    return {
        e for e in ends
        if low <= e < high - 1 and e > 0 and text[e] == " "
        and not text[e - 1].isspace() and not text[e + 1].isspace()
    }


def count_spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a long text from overlapping chunks.

    Each chunk is encoded with offsets. Left and right chunk are joined at the last stable end
    that both have in the overlap: tokens up to it count from the left, later ones from the
    right. Without a common end the overlap doubles; if it has swallowed the left chunk, the left
    chunk itself grows, at most to the whole text.
    """
    n, total = len(text), 0
    begin, stop = 0, min(chunk, n)  # the left chunk begins at a splice point

    def ends(a: int, b: int) -> list[int]:
        encoding = tokenizer.encode(text[a:b], add_special_tokens=False)
        return [a + e for _, e in encoding.offsets]

    left, skip = ends(begin, stop), 0
    while stop < n:
        width = overlap
        while True:
            start = max(begin, stop - width)
            if start == begin:  # nothing to align with: take a larger left chunk
                stop = min(n, stop + max(chunk, stop - begin))
                left, skip = ends(begin, stop), 0
                break
            right_stop = min(n, start + max(chunk, 2 * width))
            right = ends(start, right_stop)
            common = splice_points(text, left[skip:], start + 1, stop) & splice_points(
                text, right, start + 1, stop)
            if common:
                at = max(common)
                total += sum(1 for e in left[skip:] if e <= at)
                skip = next((i for i, e in enumerate(right) if e > at), len(right))
                begin, stop, left = at, right_stop, right
                break
            width *= 2
    return total + len(left) - skip


def count_long(enc: Encoder, text: str, chunk: int, overlap: int) -> int:
    if not enc.byte_level:  # no proof of stable ends for other kinds of tokenizer
        return len(enc.tokenizer.encode(text, add_special_tokens=False).ids)
    return count_spliced(enc.tokenizer, text, chunk, overlap)


@lru_cache(maxsize=4)
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def token_counts(
    df: DataFrame,
    path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    limit: int = 1024,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Bytes and tokens of each whole text, one row per input row.

    ``path`` is a `.json` file of `tokenizers` or a `.model` file of `sentencepiece`; no special
    tokens are added, nothing is cut or padded, and added tokens inside a text count as the
    library does by default. A null text counts as empty, 0 tokens. Texts above ``chunk`` code
    points take the spliced way. Ids pass through, null or repeated; other columns are not read.
    """
    if chunk < 4 * overlap:
        raise ValueError("a chunk needs at least four overlaps")

    def compute(columns):
        raw = text_bytes(columns[0])
        texts = [x.decode("utf-8", "replace") for x in raw]
        if path.endswith(".model"):
            processor = _pieces(path)
            counts = [len(processor.encode(t)) for t in texts]
        else:
            enc = encoder(path)
            counts = [
                len(enc.ids(t)) if len(t) <= chunk else count_long(enc, t, chunk, overlap)
                for t in texts
            ]
        return [[len(x) for x in raw], counts, [c > limit for c in counts]]

    return map_rows(df, [text_column], OUTPUT, compute, keep=[id_column])
