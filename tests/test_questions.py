from weftline.operators import text


def test_questions_at_any_depth(spark):
    deep = '{"sub": [' * 20 + '{"q": "fits?", "a": "yes"}' + "]}" * 20
    df = spark.createDataFrame([(deep,), ('[{"q": "b", "a": "1", "s": {"q": "c"}}, {"q": "a"}]',)], "t string")
    got = [[(x.question, x.answer) for x in r.qa] for r in text.question_answers(df, "t", ["q"], ["a"]).collect()]
    assert got == [[("fits?", "yes")], [("b", "1"), ("c", None), ("a", None)]]
