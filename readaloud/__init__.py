"""readaloud: pages and feed documents to speech-ready text, manifests and reports, on Spark.

Layers: ``functions`` (Column -> Column rules), ``operators`` (DataFrame ->
DataFrame steps), ``sources`` (tables, derived fixtures, sinks), ``plans``
(the registered queries and their SQL restatements) and ``streaming``.
"""
