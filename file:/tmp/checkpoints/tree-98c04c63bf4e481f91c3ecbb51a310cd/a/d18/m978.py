x978