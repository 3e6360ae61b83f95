"""Training-data operators: formatting, scoring, decontamination, joins,
fingerprints, toxicity, packing, personal data, language and repeats.

Nothing else in the library imports this subpackage.
"""
