x104