x151