x682