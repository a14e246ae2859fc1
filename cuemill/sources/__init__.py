"""Readers and writers of transcripts, clips, subtitles, archives, registries and event text.

Each format has column or DataFrame functions on text that is already in a
column, and a thin reader or writer of files on top.
"""
