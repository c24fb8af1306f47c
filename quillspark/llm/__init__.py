"""Text operators of a training-data pipeline: repair, split, align, encode, index, label and decontaminate."""
