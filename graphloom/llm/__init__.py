"""Operations of a training-data pipeline over a table of documents.

Nothing outside this subpackage imports it; ``queries`` holds what the entry
point registers.
"""
