"""Record types, as Spark DDL."""

# a table as one record, for interchange; the engine itself works on rows and cells
TABLE = "tableId string, documentTitle string, columns array<struct<text: string>>, rows array<struct<cells: array<struct<text: string>>>>"
ROWS = "table_id string, title string, row int, names array<string>, vals array<string>"
CELLS = "table_id string, title string, row int, col int, col_name string, value string"
PASSAGE = "p_id bigint, passage string, tag struct<table_id: string, row: int, sub_col: int, obj_col: int>"
QUERY = "qid string, mode string, table_id string, row int, sql struct<conds: array<struct<col: int, op: int, value: string>>, sel: int, agg: int>, sql_text string"
QUESTION = "id string, question string, table_id_lst array<string>, answers array<string>, ctxs array<struct<id: bigint, title: string, text: string, score: double, tag: struct<table_id: string, row: int, sub_col: int, obj_col: int>>>"
RETRIEVED = "qid string, rank int, p_id bigint, score double, table_id string"
EMBEDDING = "p_id bigint, embedding array<float>"
INTERACTION = "table struct<tableId: string>, questions array<struct<id: string, originalText: string, answer: struct<answerTexts: array<string>>, alternativeAnswers: array<struct<answerTexts: array<string>>>>>"
