"""Small fixtures shared by the tests."""

SEQS = {0: [0, 0, 1, 2, 0], 1: [1, 2, 0], 2: [2, 2, 0, 1], 3: [0, 3, 2, 1]}


def sequence_table(spark, sequences):
    items = sequences.items() if isinstance(sequences, dict) else enumerate(sequences)
    rows = [(str(k), i, s) for k, states in items for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "seq_id string, pos long, state int")


def as_dict(df, key="seq_id", value="score"):
    return {r[key]: r[value] for r in df.collect()}
