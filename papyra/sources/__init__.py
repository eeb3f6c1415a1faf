"""Tables, files and the corpus that queries run on."""
