x723