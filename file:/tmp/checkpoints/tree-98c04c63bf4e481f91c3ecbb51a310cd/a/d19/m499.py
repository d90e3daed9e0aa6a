x499