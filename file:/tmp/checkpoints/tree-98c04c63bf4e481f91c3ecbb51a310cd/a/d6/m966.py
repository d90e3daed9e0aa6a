x966