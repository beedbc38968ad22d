"""Operations of a training-data pipeline.

Ten operators over text tables. Nothing else in the package imports this
subpackage; its queries and their SQL are in :mod:`quarry.llm.queries`.

Rules that hold for all of them: a null text counts as an empty one, whole texts
are read, repeated rows are kept as rows of their own, an empty table gives an
empty result of the same schema, and further columns of the input, whatever
their names, never collide with what an operator adds.
"""
