x709