x79