x127