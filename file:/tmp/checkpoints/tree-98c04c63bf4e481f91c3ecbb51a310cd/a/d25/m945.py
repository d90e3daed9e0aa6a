x945