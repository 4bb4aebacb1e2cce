import random

import pytest
from pyspark.sql import functions as F

from chatquarry.functions import answers, boxed, chat, udfs
from chatquarry.functions import text as tx

#: (completion, gold, reward): the fixed cases of the reward's audit.
AUDIT = [
    (r"Reasoning... \boxed{42}", "42", 1.05), (r"x = \boxed{-7}", "-7", 1.05), (r"Therefore \boxed{3.14}", "3.14", 1.05), (r"\boxed{\frac{1}{2}}", r"\frac{1}{2}", 1.05),
    (r"Color: \boxed{red}", "red", 1.05), (r"\boxed{42}", "7", 0.05), (r"\boxed{5}", "-5", 0.05), (r"\boxed{99}", "100", 0.05), ("The answer is 42.", "42", 0.0),
    ("Answer: 42", "42", 0.0), ("", "42", 0.0), (r"First try \boxed{42}; on review \boxed{43}.", "43", 1.05), (r"First \boxed{43}, then \boxed{42}.", "43", 0.05),
    (r"\boxed{1} \boxed{2} \boxed{3}", "3", 1.05), (r"\boxed{\frac{1}{2}}", "0.5", 1.05), (r"\boxed{\dfrac{1}{2}}", r"\frac{1}{2}", 1.05), (r"\boxed{1/2}", "0.5", 1.05),
    (r"\boxed{\dfrac{3}{4}}", "0.75", 0.05), (r"\boxed{2\sqrt{3}}", r"\sqrt{12}", 0.05), (r"\boxed{\sqrt{2}}", r"\sqrt{2}", 1.05), (r"\boxed{}", "42", 0.0), (r"\boxed{ }", "42", 0.0),
    (r"Reasoning... \boxed{42 + ", "42", 0.0), (r"Leading text \boxed{", "42", 0.0), (r"\boxed{ 42 }", "42", 1.05), (r"\boxed{42\,000}", "42000", 0.05), (r"\boxed{\text{42}}", "42", 1.05),
    (r"\boxed{-5}", "-5", 1.05), (r"\boxed{- 5}", "-5", 1.05), (r"\boxed{+5}", "5", 0.05),
]


def one(spark, values, *columns, kind="string"):
    rows = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [tuple(r) for r in rows.select(*[c(F.col("x")).alias(f"c{i}") for i, c in enumerate(columns)]).collect()]


def test_audit(spark):
    from chatquarry.operators.score import reward

    rows = spark.createDataFrame(AUDIT, "t string, g string, r double")
    for r in rows.select("t", "r", reward(F.col("t"), F.col("g")).alias("got")).collect():
        assert r.got == pytest.approx(r.r), r.t


def test_extractors(spark):
    texts = [r"\boxed{42}", r"\boxed{\frac{1}{2}}", r"\boxed{1} then \boxed{2}", "none", r"\boxed{\{1\}}", r"\boxed{1} \boxed{2", r"\boxed {7}", r"\fbox{3}", r"\boxed{{5}}", r"a } \boxed{6}", None, ""]
    got = one(spark, texts, lambda x: boxed.score_answer(x, peel=False), lambda x: boxed.split_box(x).inside, boxed.level_box)
    assert got == [
        ("42", "42", "42"), (r"\frac{1}{2}",) * 3, ("2", "2", "2"), (None,) * 3, (r"\{1\}",) * 3, (None,) * 3, (None, "7", None), ("3", None, None), ("{5}",) * 3, ("6", "6", "6"), (None,) * 3, (None,) * 3,
    ]


def _closing(rest, depth):
    for k, c in enumerate(rest):
        depth += (c == "{") - (c == "}")
        if c == "}" and depth == 0:
            return k
    return None


def test_score_span_on_random_strings(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["{", "}", "x", "\\boxed", "\\fbox", " ", "\\{"]) for _ in range(rng.randrange(12))) for _ in range(400)]

    def expected(t):
        at = max(t.rfind("\\boxed"), -1)
        at = at if at >= 0 else t.rfind("\\fbox")
        if at < 0 or (k := _closing(t[at:], 0)) is None:
            return None
        return t[at : at + k + 1]

    assert [r[0] for r in one(spark, texts, boxed.score_span)] == [expected(t) for t in texts]


def test_strip_preamble(spark):
    cases = {"work. The answer is: $": "work.", "work $$": "work", "work \\[": "work", "x\nFinal answer:\n": "x", "Answer:": "", "canswer:": "canswer:", "The answer is 3": "The answer is 3", "a $ b": "a $ b", "x ANSWER: \\( ": "x"}
    assert [r[0] for r in one(spark, list(cases), boxed.strip_preamble)] == list(cases.values())


def test_normal_forms_are_stable_where_they_should_be(spark):
    pairs = {"1,000": "1000", "\\frac12": "\\frac{1}{2}", "\\text{red}": "red", "12 cm": "12", "$7$": "7", "the final answer is 3": "3"}
    assert [r[0] for r in one(spark, list(pairs), answers.normal_form)] == list(pairs.values())
    pairs = {"\\frac1": "\\frac1", "\\frac1{2}": "\\frac{1}{2}", "007/2": "007/2", "3/4": "\\frac{3}{4}", "k=5": "5", "abc=5": "abc=5", "": "", "5.": "5", "3j": "3i", "1.500": "1.500", "2.00": "2"}
    assert [r[0] for r in one(spark, list(pairs), answers.stripped_form)] == list(pairs.values())


def test_equivalence_of_nulls(spark):
    rows = spark.createDataFrame([(None, None), (None, "1"), ("1", None), ("1", "1")], "a string, b string")
    assert [r[0] for r in rows.select(answers.equivalent(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]
    assert [r[0] for r in rows.select(answers.correct(F.col("a"), F.col("b"), "boxed")).collect()] == [False, False, False, True]


def test_choices(spark):
    cases = {"(b)": "B", "c.": "C", "I think B": None, "it is d": "D", "no": None, "": None}
    assert [r[0] for r in one(spark, list(cases), answers.choice_label)] == list(cases.values())


def test_direct_answers(spark):
    gold = F.lit('["Paris", "City of Light"]')
    right = lambda x: answers.correct(answers.extract(x, "knowledge", gold), gold, "knowledge")
    assert [r[0] for r in one(spark, ["The final answer is: PARIS!", "city  of light.", "Rome", "answer paris"], right)] == [True, True, False, False]
    assert [r[0] for r in one(spark, ["1e3", "true", "null", '["a", 1.50]', "x"], udfs.exact_aliases)] == [["1000.0"], ["True"], ["None"], ["a", "1.5"], ["x"]]
    assert one(spark, ["Straße"], udfs.casefold) == [("strasse",)]


def test_levels_and_subjects(spark):
    got = one(spark, ["5", " Level 5 ", "Level ?", "hard", "", None], tx.level_of_training, tx.level_of_extraction, tx.level_of_test)
    assert got == [("Level 5",) * 3, ("Level 5", "Level 5", "Level  Level 5 "), ("Level ?", None, "Level ?"), ("hard", None, "Level hard"), (None, None, None), (None, None, None)]
    assert one(spark, ["Counting & Probability"], tx.subject_slug) == [("counting_and_probability",)]
    assert one(spark, ["org/Model-1.7B"], tx.source_tag) == [("model_1_7b",)]
    assert tx.parse_levels("4, Level 5") == ("Level 4", "Level 5")
    with pytest.raises(ValueError):
        tx.parse_levels("hard")


def test_repeats(spark):
    assert [r[0] for r in one(spark, ["x" * 300, "x" * 299, "ab" * 10, None, "".join(map(str, range(300)))], udfs.repeats)] == [True, False, False, False, False]


def test_failure_modes(spark):
    rows = spark.createDataFrame([(True, "1", True, 1, "t"), (False, "1", True, 1, "t"), (False, None, False, 9999, "t"), (False, "1", False, 4090, "t"), (False, "1", False, 4090, "\\boxed{1}"), (False, "1", False, 4089, "t")], "rep boolean, x string, ok boolean, n int, t string")
    got = [r[0] for r in rows.select(tx.failure_mode(F.col("rep"), F.col("x"), F.col("ok"), F.col("n"), F.col("t"))).collect()]
    assert got == ["repetition", "correct", "no_box", "truncated", "wrong_box", "wrong_box"]


def test_render(spark):
    messages = F.array(chat.message("system", F.lit("S")), chat.message("user", F.lit("Q")), chat.message("tool", F.lit("gone")), chat.message("assistant", F.lit("<think>\nr\n</think>\n\n\nA")), chat.message("assistant", F.lit("<think>x")))
    got = spark.range(1).select(chat.render(messages, generate=True)).first()[0]
    assert got == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nQ<|im_end|>\n<|im_start|>assistant\n<think>\nr\n</think>\n\nA<|im_end|>\n<|im_start|>assistant\n<think>x</think>\n\n<think>x<|im_end|>\n<|im_start|>assistant\n"
    assert one(spark, ["q"], lambda x: chat.templated(chat.generation_prompt(x))) == [(True,)]


def test_native_columns_have_no_python_node(spark):
    rows = spark.createDataFrame([("a", "b")], "a string, b string")
    plan = rows.select(answers.equivalent(boxed.score_answer(F.col("a")), F.col("b")), boxed.strip_preamble(F.col("a")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def closing(text, depth, escapes):
    hidden = False
    for n, c in enumerate(text, 1):
        if hidden:
            hidden = False
        elif escapes and c == "\\":
            hidden = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return n
    return None


def test_closing_brace_at_any_depth(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice(["{", "{", "}", "}", "\\", "a", "\n", "é"]) for _ in range(rng.randrange(30))) for _ in range(1500)]
    texts += ["{" * 12 + "x" + "}" * 12, "{" * 500, "x" * 3000 + "}" * 3]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for escapes in (False, True):
        got = [r.n for r in df.select(boxed._closing(F.col("t"), 1, escapes).alias("n")).collect()]
        assert got == [closing(t, 1, escapes) for t in texts]
    behind = ["\\boxed{" + t for t in texts]
    got = [r.n for r in spark.createDataFrame([(t,) for t in behind], "t string").select(boxed._closing(F.col("t"), 0, False).alias("n")).collect()]
    assert got == [closing(t, 0, False) for t in behind]


def test_split_box_looks_behind_commands_without_a_brace(spark):
    texts = ["a \\boxed{1} b \\boxed", "a \\boxed {1} \\boxedx", "\\boxed", "a \\boxed{1} \\boxed {2", "x" * 300 + " \\boxed\n{3}"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(boxed.split_box(F.col("t")).alias("p"))
    assert [r.p and (len(r.p.before), r.p.inside) for r in df.collect()] == [(2, "1"), (2, "1"), None, None, (301, "3")]


def test_long_preambles_are_stripped(spark):
    ends = ["", " The answer is: $", "x the answer is" + " " * 400, "$" * 300, " final answer:" * 40, "xanswer: $$ \\["]
    texts = [("word " * 100 + "end" + e) for e in ends] + [e for e in ends]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(boxed.strip_preamble(F.col("t")).alias("s")).collect()]
    base = "word " * 100 + "end"
    assert got == [base, base, base + "x", base, base, base + "xanswer:", "", "", "x", "", "", "xanswer:"]
