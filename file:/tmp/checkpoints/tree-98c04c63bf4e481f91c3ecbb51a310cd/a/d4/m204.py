x204