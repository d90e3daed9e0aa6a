x235