"""Training-data operators: near duplicates, language ID, decontamination, token files, ...

Nothing else in the library imports this subpackage.
"""
