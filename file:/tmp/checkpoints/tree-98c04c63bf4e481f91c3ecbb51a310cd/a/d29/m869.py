x869