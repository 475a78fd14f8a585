import numpy as np

from loomspark.operators import embed


def test_each_text_reaches_the_model_once(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def make():
        import uuid

        def model(texts):
            (seen / uuid.uuid4().hex).write_text("\n".join(texts))
            return np.array([[len(t), t.count("a")] for t in texts], np.float32)

        return model

    def asked():
        return sorted(line for f in seen.iterdir() for line in f.read_text().split("\n"))

    def run(rows):
        got = embed.embed(spark.createDataFrame(rows, "id long, text string"), make, f"file://{tmp_path}/store", "id", batch=3)
        return {r.id: (r.vector and list(r.vector), r.fresh) for r in got.collect()}

    first = [(i, f"text {'a' * (i % 5)}") for i in range(10)] + [(20, None), (21, "  ")]
    got = run(first)
    assert got[3] == ([8.0, 3.0], True) and got[8] == got[3] and got[20] == (None, False) == got[21]
    assert asked() == sorted(f"text {'a' * k}" for k in range(5))
    got = run([*first, (30, "banana"), (31, "banana")])
    assert got[3] == ([8.0, 3.0], False) and got[30] == ([6.0, 3.0], True) == got[31]
    assert asked() == sorted([*(f"text {'a' * k}" for k in range(5)), "banana"])
