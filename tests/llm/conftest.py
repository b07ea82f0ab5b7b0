import random
from dataclasses import dataclass

import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators give to columns of their own, at some place.
CLASHING = (
    "size shard fp bucket label key block held_out score x base row mark text_mark name hits items a n id least nameless root node u v part own skip slot law rank low high cell before bytes number "
    "n_words n_hit words docs more answer seen fold kind mask last after doc_ID_ n_tokens fingerprint component_id "
    "__id __text __at __line __h __batch __docs __last __held __held_last __n __l __one __drop __lines __gone __kept __mark __size __crc __same __shard __new __base __all __more "
    "__n0 __n3 __base0 __base3 __more0 __more3"
).split()


@dataclass
class Corpus:
    rows: list  # (doc_id, text)
    frame: object
    empty: object


def awkward() -> list:
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeäß") for _ in range(rng.randint(1, 9)))
    long = "\n".join(" ".join(word() for _ in range(12)) for _ in range(400))
    line = "This very line is Repeated in many documents"
    rows = [(10_000, None), (10_001, ""), (10_002, "   \n\t "), (10_003, "x"), (10_003, "x"), (10_004, "\n\n"), (10_005, "a b c"), (10_006, long), (10_007, long), (10_008, long.replace("a", "b", 3)), (None, "no id here"), (None, None), (10_009, "a" * 30_000), (10_010, "日本語 テスト é x y 🎉🎉 <|endoftext|> end'll\x00\x1c"), (10_011, "tie tie tie tie tie tie")]
    rows += [(10_020 + k, f"{word()}\n  {line.upper() if k % 2 else line}\t\n{word()} {word()}\n{line}") for k in range(6)]
    return rows


@pytest.fixture(scope="session")
def corpus(spark):
    """All documents of the smallest table, and awkward ones, with columns whose names the operators use too."""
    own = pd.read_parquet(f"{SF}/documents.parquet")
    rows = [*zip(own.doc_id.tolist(), own.text.tolist()), *awkward()]
    full = [(i, t, "en", "s", len(t or ""), *[str(k) for k in range(len(CLASHING))]) for i, t in rows]
    schema = COLUMNS + "".join(f", {c} string" for c in CLASHING)
    return Corpus(rows, spark.createDataFrame(full, schema).repartition(5), spark.createDataFrame([], schema))


def ordered(values):
    return sorted(values, key=lambda x: tuple((v is not None, v) for v in x))
