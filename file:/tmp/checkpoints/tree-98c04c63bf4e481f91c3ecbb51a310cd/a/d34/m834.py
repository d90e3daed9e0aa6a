x834