"""Small hand-made tables for the operators that need English: sentences, relations between terms, jobs, facts.

The sentences are written for this library, one for each pattern or trap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SENTENCES = {
    1: "A valve is a small device that controls the flow of water.",
    2: "A pump is a small device that moves the water to a tank.",
    3: "A dam is defined as a strong wall of stone.",
    4: "Grafting is defined as joining a shoot to an old root.",
    5: "A suspension bridge, a cable-borne bridge, carries its deck on ropes.",
    6: "A lute is a type of string instrument.",
    7: "A lute is not a string instrument at all.",
    8: "A lute could be a string instrument of some kind.",
    9: "There is a string instrument called a lute.",
    10: "A lute is another string instrument entirely.",
    11: "A delta is a low plain of sand and mud in geology.",
    12: "A delta is a low-lying plain consisting of sand and mud.",
    13: "A lute is a string instrument and a drum is percussion.",
    21: "The clock consists of gears with a spring and two brass hands.",
    22: "A steam engine has a thermal capacity of modest size in the usual case. Engines have been measured for decades by many makers.",
    23: "The engine contains a valve at the top of the cylinder.",
    25: "The difference between a lute and a harp is the shape of the frame.",
    26: "Unlike ferries, suspension bridges do not require calm weather.",
    27: "Suspension bridges do not require calm weather.",
    28: "A pulley can be used to move a load in stages.",
    29: "The machine first sorts the grain and then joins the two batches.",
    30: "The pump draws the water, changes it, and returns it immediately.",
    31: "Floods occur when two rivers join at the same town.",
    32: "When a valve is opened, the hot steam is pushed into the cylinder.",
    33: "The bridge is of fixed length in most designs.",
    34: "A lute differs from a harp in the shape of the frame.",
    35: "Granite is harder than soft limestone.",
    36: "A pulley is used for steady support of loads.",
    37: "A ledger is useful for comparison of many sales.",
    38: "The lever enables a movement of the whole load.",
    39: "The recipe begins by measuring the dry beans.",
    40: "Grafting joins a shoot to a root, and a callus occurs when two shoots share a root. A callus is removed by trimming.",
}

#: Texts with lines that are headings, and with lines that only look like some.
HEADED = {
    51: "# Water Works\nA valve is a small device.\n## The Pump And Its Parts\nIt moves water.\nnot a heading at all\nShort End:\nWater Of The River Delta",
    52: "RIVERS AND SEAS\n\nA delta is a low plain.\n Lutes And Harps \n#no space\nThis line Ends in lower case words\nAb\nEngines, Boats And Bridges?",
    53: "",
    54: "\n".join(f"Part {chr(65 + i)} Of The Book" for i in range(15)),
}

LESSON = (
    "A valve is a small device that controls the flow of water. A pump is a small device that moves the water to a tank. "
    "A suspension bridge is a cable-borne bridge that carries its deck on ropes. A delta is a low-lying plain consisting of sand and mud. "
    "The clock consists of gears with a spring and two brass hands. The difference between a valve and a pump is the source of the force. "
    "A pulley can be used to move a load in stages. Unlike ferries, suspension bridges do not require calm weather. "
    "The crank adds a push to the top of a pump. When a valve is opened, the hot steam is pushed into the cylinder. "
    "A ledger is a large book that holds each sale with its value. Floods occur when two rivers join at the same town."
)

#: (doc_id, rank, term, back, family, confidence, other), best first.
FACTS = [
    (1, 1, "tree", "Nodes with a key.", "PROPERTY", 0.9, None),
    (1, 2, "tree", "A fixed height limit.", "PROPERTY", 0.85, None),
    (1, 3, "stack", "The order of removal.", "COMPARISON", 0.85, "queue"),
    (1, 4, "Tree", "Keeping keys in order.", "PURPOSE", 0.8, None),
    (1, 5, "tree", "Splits a full node.", "PROCESS", 0.75, None),
    (1, 6, "tree", "Slower than a table.", "COMPARISON", 0.7, "table"),
    (1, 7, "list", "nodes with a key", "PROPERTY", 0.65, None),
    (1, 8, "list", "Growing without copies.", "PURPOSE", 0.6, None),
    (2, 1, "heap", "Scheduling of many jobs.", "PURPOSE", 0.65, None),
    (2, 2, "heap", "Sifts the last item up.", "PROCESS", 0.55, None),
    (2, 3, "heap", "A complete binary tree.", "PROPERTY", 0.5, None),
]

RELATIONS = [
    ("stack", "wider", "data structure"), ("queue", "wider", "data structure"), ("linked list", "wider", "list"), ("array list", "wider", "list"),
    ("list", "wider", "data structure"), ("data structure", "wider", "concept"), ("stack", "same", "LIFO queue"), ("push", "antonym", "pop"), ("pop", "antonym", "push"),
]

TERMS = [(1, t) for t in ("stack", "queue", "linked list", "array list", "doubly linked list", "list", "data structure", "push", "pop", "LIFO queue", "42", "tree")]

JOBS = [
    '{"job_id": "j1", "text": "A valve is a small device.", "reply_to": "q1", "correlation_id": "c1"}',
    '{"job_id": "j2", "text": "A pump is a small device.", "options": {"max_cards": 3}}',
    '{"job_id": "j3"}',
    "not a job",
    '{"job_id": "j4", "text": "", "correlation_id": null}',
]


def sentences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SENTENCES.items()), "doc_id long, text string")


def headed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(HEADED.items()), "doc_id long, text string")


def lesson(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, LESSON)], "doc_id long, text string")


def fact_rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FACTS, "doc_id long, rank int, term string, back string, family string, confidence double, other string")


def relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RELATIONS, "term string, relation string, other string")


def terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TERMS, "doc_id long, term string")


def job_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(j,) for j in JOBS], "value string")
