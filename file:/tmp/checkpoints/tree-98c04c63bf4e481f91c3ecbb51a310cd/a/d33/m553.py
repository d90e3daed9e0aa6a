x553