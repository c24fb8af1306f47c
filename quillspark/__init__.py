"""quillspark: a Spark-native engine for document retrieval and evidence analytics.

Operators are functions ``DataFrame -> DataFrame``; they hold no session of their own and collect nothing that
grows with the data. ``quillspark.llm`` adds the text operators of training-data pipelines on top; nothing else
in the package imports it.
"""
