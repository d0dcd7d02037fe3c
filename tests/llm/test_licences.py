"""What the licence classifier learns from."""

from collections import Counter

from brute import frame
from pyspark.sql import functions as F

from loglode.llm.licenses import LEAST_PROBABILITY, _grams, plain_lines, thresholds


def test_all_lines_teach_the_licence_classifier(spark):
    # More texts than 400, a text of more lines than 100, and one of more characters than 50,000.
    rows = [(k, f"text number{k} of the software") for k in range(600)] + [(1000, "\n".join(f"line{k} in a file" for k in range(150)))]
    rows += [(1001, "the last version\n" + "word " * 12_000), (1002, None), (1003, "\n \n")]
    got = [" ".join(r.words) for r in plain_lines(frame(spark, rows)).collect()]
    assert Counter(got) == Counter(line.strip() for _, t in rows for line in (t or "").split("\n") if line.strip())
    touched = [" ".join(r.words) for r in plain_lines(frame(spark, rows), touching=True).collect()]
    assert Counter(touched) == Counter(x for x in got if "software" in x or "file" in x or "version" in x)
    # Grams are words of templates and pairs with one; held lines count by their number.
    grams = spark.range(1).select(_grams(F.split(F.lit("we saw the software of the year the software"), " ")).alias("g")).first().g
    assert grams == ["software", "software of", "the software"]
    assert thresholds([(1, 0.99, 2), (1, 0.8, 5), (2, 0.9, 1)], 300, 2) == [0.99 + 1e-6, LEAST_PROBABILITY]
