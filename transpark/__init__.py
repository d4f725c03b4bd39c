"""transpark: parallel-corpus curation, augmentation and MT evaluation as Spark DataFrame jobs.

functions/  column expressions (words, TTR, 13a tokens, rule tables, HTML unescape)
sources/    text corpora, stored run outputs, generation logs, vocabularies; sinks
operators/  selection, numbering, BLEU, vocabulary/ids, text jobs, assembly, run metrics, UDF jobs
plans/      compositions (workflows) and the registered driver queries with their SQL twins
"""
