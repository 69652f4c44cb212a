"""Readers: delimited tables, spreadsheets, captions, HTML, Markdown, logs. Each attaches an ordinal."""
