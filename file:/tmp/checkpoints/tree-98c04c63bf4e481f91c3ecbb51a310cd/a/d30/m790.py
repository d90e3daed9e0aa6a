x790