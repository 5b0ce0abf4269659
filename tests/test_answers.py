"""Golden vectors of answer extraction, normal forms and equivalence."""

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import answers as A
from tallyforge.functions import text as T

EXTRACT = [
    ("so \\boxed{42}.", "eos", "42", "boxed"),
    ("\\boxed{1+\\boxed{2}}", "eos", "2", "boxed"),
    ("\\boxed{\\frac{1}{2}} then \\boxed{open", "eos", "\\frac{1}{2}", "boxed"),
    ("work\n#### 18", "eos", "18", "hash_answer"),
    ("####\n7", "eos", "7", "hash_answer"),
    ("The answer is: 5.", "eos", "5", "labeled_answer_line"),
    ("Final answer = (b)", "eos", "B", "labeled_answer_line"),
    ("answer is eleven\nw\nw\nw\nw\nw", "eos", "E", "labeled_answer"),
    ("answer: 3/4\nw\nw\nw\nw\nw", "eos", "3", "labeled_answer"),
    ("x\nC", "eos", "C", "final_line_choice"),
    ("x\nC", "length", "C", "final_line_choice"),
    ("we get\n3/4", "eos", "3/4", "final_line_numeric"),
    ("we get\n3/4", "length", None, "truncated_no_final_answer"),
    ("about 12 apples in total", "eos", "12", "tail_number"),
    ("about 12 apples in total", "length", None, "truncated_no_final_answer"),
    ("no digits here", "eos", None, "not_found"),
    ("", "eos", None, "not_found"),
    (None, "eos", None, "not_found"),
    ("\\boxed{}\n#### 4", "eos", "4", "hash_answer"),
    ("\\boxed{" + "x" * 6000 + "}", "eos", "x" * 6000, "boxed"),
    ("\\boxed{1} \\boxed{" + "{" * 60 + "7" + "}" * 60 + "} \\boxed{open", "eos", "{" * 60 + "7" + "}" * 60, "boxed"),
    ("\\fbox{a\\boxed{" + "{" * 30 + "}" * 30 + "b}}", "eos", "{" * 30 + "}" * 30 + "b", "boxed"),
]

NORMAL = [
    ("1,000.50", "1000.5"), ("1,2", "12"), ("\\frac{2}{4}", "1/2"), ("6/3", "2"), ("-4/-2", "2"), ("1/0", "1/0"), ("\\left(1, 2\\right)", "(1,2)"),
    ("x = 5", "5"), ("(b)", "B"), ("$7$.", "7"), ("007", "7"), ("-0", "0"), ("50%", "50%"), ("", None), ("$", None), (None, None), ("-0.50", "-0.5"), ("3/-6", "-1/2"), (f"{10**30}/{10**31}", "1/10"), ("0/7", "0"), ("+5/10", "1/2"), ("-6" + "0" * 5000 + "/4" + "0" * 5000, "-3/2"),
]

COMPARE = [
    (None, "5", "", False, False, "no_prediction"),
    ("5", "5", "", True, True, "strict_exact"),
    ("0.5", "1/2", "", False, True, "numeric_equivalent"),
    ("50%", "0.5", "", False, True, "numeric_equivalent"),
    ("5 cm", "5", "", False, True, "numeric_equivalent"),
    ("25%", "25", "what percent", False, True, "percent_context_equivalent"),
    ("25%", "25", "what", False, False, "none"),
    ("It is 12 apples", "12", "", False, True, "embedded_numeric_equivalent"),
    ("3\\sqrt{2}\\text{ cm}", "3\\sqrt{2}", "", False, True, "unit_stripped_exact"),
    ("B", "20", "Pick:\nA. 10\nB. 20", False, True, "choice_letter_to_content"),
    ("20", "B", "Pick:\nA. 10\nB. 20", False, True, "choice_content_to_letter"),
    ("7", "8", "", False, False, "none"),
    ("7", "", "", False, False, "none"),
    (f"{2 * 10**40}/{4 * 10**40}", "0.5", "", False, True, "numeric_equivalent"),
    ("0." + "3" * 40, "0." + "3" * 39, "", False, False, "none"),
    ("0." + "3" * 40 + "0", "0." + "3" * 40, "", False, True, "numeric_equivalent"),
    ("1" + "0" * 30 + "%", "1" + "0" * 28, "", False, True, "numeric_equivalent"),
]


def test_extraction(spark):
    rows = spark.createDataFrame([(i, t, f) for i, (t, f, *_) in enumerate(EXTRACT)], "i int, t string, f string")
    got = rows.select("i", A.extract_answer(F.col("t"), F.col("f")).alias("x")).orderBy("i").collect()
    assert [(r.x.answer, r.x.method) for r in got] == [e[2:] for e in EXTRACT]


def test_normal_forms(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NORMAL)], "i int, t string")
    got = A.with_normal(rows, x=F.col("t")).orderBy("i").collect()
    assert [r.x for r in got] == [e[1] for e in NORMAL]


def test_equivalence(spark):
    rows = spark.createDataFrame([(i, *e[:4]) for i, e in enumerate(COMPARE)], "i int, p string, r string, m string, s boolean")
    got = A.compare_answers(rows, "x", F.col("p"), F.col("r"), F.col("m"), F.col("s")).orderBy("i").collect()
    assert [(r.x.equal, r.x.method) for r in got] == [e[4:] for e in COMPARE]


@pytest.mark.parametrize(
    ("stops", "pad", "most", "ids", "kept", "reason", "hit"),
    [
        ([9], 0, 8, [5, 6, 9, 0, 0], [5, 6], "eos", False),
        ([9], 0, 8, [5, 6, 0, 0], [5, 6], "length", False),
        ([9], 0, 3, [5, 6, 7, 9], [5, 6, 7], "length", True),
        ([0], 0, 8, [5, 0, 0], [5], "eos", False),
        ([9], 0, 8, [], [], "length", False),
    ],
)
def test_finish_reason(spark, stops, pad, most, ids, kept, reason, hit):
    got = spark.createDataFrame([(ids,)], "ids array<int>").select(A.finish_reason(F.col("ids"), stops, pad, most).alias("x")).first().x
    assert (got.ids, got.reason, got.hit_max) == (kept, reason, hit)


def test_text_functions(spark):
    row = spark.createDataFrame([("a" + "\r\n" * 4 + "b", " Step\u00a01 \n", "step   1 then", "x" * 4, "w " * 60, "w " * 59)], "a string, b string, c string, d string, e string, f string")
    got = row.select(
        T.normalize_text(F.col("a")), T.collapse(F.col("b")), T.starts_alike(F.col("c"), F.col("b")), T.abnormal(F.col("d")), T.abnormal(F.col("e")), T.abnormal(F.col("f"))
    ).first()
    assert list(got) == ["a\n\n\nb", "Step 1", True, True, True, False]


def test_repeated_lines_are_abnormal(spark):
    rows = [("one line\n" * 3 + "two\nthree\nfour", True), ("one line\n" * 2 + "two\nthree\nfour\nfive", False), ("text <|end", True), (None, None)]
    got = spark.createDataFrame(rows, "t string, e boolean").select(T.abnormal(F.col("t")).alias("x"), "e").collect()
    assert [bool(r.x) for r in got] == [bool(r.e) for r in got]


def test_workers_need_no_copy_of_the_package(tmp_path):
    """The functions that run in workers load and run in a process that can't import the package."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    (tmp_path / "sent").write_bytes(cloudpickle.dumps((A._shown.func, A._same_long.func)))
    code = """
import pickle, pandas as pd
shown, same = pickle.load(open("sent", "rb"))
long = "1" + "0" * 30
rows = pd.DataFrame({"p": ["6", long, None], "q": ["-4", long, None], "t": [None, None, "x"]})
pair = {"p1": long, "q1": "1", "t1": None, "p2": long, "q2": "1", "t2": None}
print(list(shown(rows)), list(same(pd.Series([[pair, None], None]))))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0 and done.stdout.strip() == "['-3/2', '1', 'x'] [[True, None], None]", done.stdout + done.stderr
