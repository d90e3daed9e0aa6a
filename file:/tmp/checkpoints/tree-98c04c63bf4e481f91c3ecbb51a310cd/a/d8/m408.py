x408